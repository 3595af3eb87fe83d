"""The links of operator 2, against all pairs."""

import collections

import duckdb
import pytest

from check_queries import compare
from tablescope.llm import jaccard, links
from workloads.common import TABLES

from .conftest import ROWS, sentence
from .test_text_operators import changed, words

SF = "/root/testdata/sf0.001"


def shingles(text, n):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


@pytest.mark.parametrize("n, percent, block", [(4, 85, 1_000), (5, 80, 7), (1, 50, 1_000)])
def test_no_link_is_lost(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(links, "BLOCK_CLASSES", block)
    monkeypatch.setattr(links, "COLUMNS", 50)
    base = sentence(77, 120)
    rows = [(i, t) for i, t, _, _ in ROWS] + [(100 + k, changed(base, k, 1 + k % 4)) for k in range(60)] + [(300 + k, sentence(500 + k // 3, 12)) for k in range(30)]
    sets = [shingles(t, n) for _, t in rows]
    like = {(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    counts = collections.Counter(i for i, _ in like)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["n_links"]) for r in links.link_counts(docs, n, percent).collect())
    assert got == sorted((str(doc), len(sets[i]), counts[i]) for i, (doc, _) in enumerate(rows))
    found = jaccard.classes_of(docs, n, percent)
    pairs = [tuple(r) for r in links.class_links(found, percent).collect()]
    unlike = {tuple(sorted(map(frozenset, (sets[i], sets[j])), key=hash)) for i, j in like if sets[i] != sets[j]}
    assert len(pairs) == len(set(pairs)) == len(unlike) and all(a < b for a, b in pairs)


def test_links_of_an_empty_table(nothing):
    assert links.link_counts(nothing).count() == 0 and links.class_links(jaccard.classes_of(nothing)).count() == 0


def test_links_twin(spark):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    name = "op2_ngram_jaccard_links"
    ok, _, note = compare(spark, db, SF, name, links.QUERIES[name], links.ORACLES[name])
    assert ok, note
