"""Operators 11 to 13 against plain versions of themselves."""

import hashlib
import random
import zlib

import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablescope.llm import merkle, pieces, repeats

from .conftest import ROWS


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 Merkle manifest --------------------------------------------------------------------------------------


def plain_leaf(row, more=0):
    doc_id, text, lang, source, n = row
    values = [doc_id, source, lang, None if n is None else n + more, text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """Root, and for each leaf its steps: (it is on the right, sibling) or None."""
    where, ways = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for way, k in zip(ways, where):
            way.append((k % 2, nodes[k ^ 1]) if k ^ 1 < len(nodes) else None)
        nodes = [sha("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
        where = [k // 2 for k in where]
    return nodes[0], ways


def plain_manifest(rows):
    def first_null(value):
        return (value is not None, value or 0)

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: sorted((r for r in rows if r[2] == lang), key=lambda r: (first_null(r[0]), plain_leaf(r))) for lang in langs}
    found = {lang: plain_tree([plain_leaf(r) for r in trees[lang]]) for lang in langs}
    root, upper = plain_tree([found[lang][0] for lang in langs])
    out = []
    for lang, above in zip(langs, upper):
        for row, way in zip(trees[lang], found[lang][1]):
            node = plain_leaf(row, int(zlib.crc32(str("" if row[0] is None else row[0]).encode()) % 7 == 0))
            for step in way + above:
                node = sha(node if step is None else step[1] + node if step[0] else node + step[1])
            out.append((row[0], plain_leaf(row), found[lang][0], root, sha("".join(s[1] for s in way + above if s)), node, node == root))
    return sorted(out, key=str)


def as_rows(found):
    return sorted(map(tuple, found.collect()), key=str)


def queried(docs, bits):
    tampered = F.when(merkle.fold("doc_id", 7) == 0, merkle.leaf_hash({"n_chars": F.col("n_chars") + 1}))
    proof = merkle.manifest(docs, tampered, bits).withColumn("proof", merkle.steps(F.col("path")))
    proof = proof.withColumn("folded", merkle.folded(F.coalesce("extra", "leaf"), F.col("proof")))
    return proof.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof.sibling", ""), 256), "folded", F.col("folded") == F.col("root"))


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_is_the_plain_one(awkward, bits):
    assert as_rows(queried(awkward, bits)) == plain_manifest([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in ROWS])


def test_one_leaf_and_none(awkward, nothing):
    one = awkward.filter("doc_id = 9")
    (row,) = merkle.manifest(one).collect()
    assert row["leaf"] == row["subroot"] == row["root"] and len(row["path"]) == 0
    assert merkle.manifest(nothing).count() == 0


def test_ancestors_may_be_shuffled(spark, awkward, monkeypatch):
    """Without a broadcast the same paths come out."""
    rows = [(k, f"text {k}", "en" if k % 3 else "de", "web", k) for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", 0)
    assert as_rows(queried(docs, 3)) == plain_manifest(rows)


# 12 SentencePiece ----------------------------------------------------------------------------------------

OWN, LIBRARY = pieces.Vocabulary(), sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("▁  \n\tab thing12<s>�é漢"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_ids_and_text_are_the_librarys(text):
    (ids,) = OWN.encode([text])
    assert ids == LIBRARY.encode(text, add_eos=True) and OWN.decode(ids) == LIBRARY.decode(ids) and not OWN.differs


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    assert OWN.decode(ids) == LIBRARY.decode(ids)


def test_long_spans_and_forgetting(monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    own, rng = pieces.Vocabulary(), random.Random(3)
    for _ in range(30):
        texts = ["".join(rng.choice("abcdeing") for _ in range(rng.randint(0, 400))) for _ in range(3)] + ["a b c d e f g h i j k l m n"]
        assert own.encode(texts) == LIBRARY.encode(texts, add_eos=True)
    assert own.encode(["thing"], end=False) == [LIBRARY.encode("thing")]


def test_a_disagreement_shows(awkward):
    own = pieces.Vocabulary()
    own.costs.clear()
    own.pair_costs[:] = float("inf")
    (spans,) = own.spans_of(["thing"])
    assert not own.differs.isdisjoint(spans)


def test_encoded_rows(awkward, nothing):
    texts = sorted([t or "" for _, t, _, _ in ROWS])
    rows = pieces.encoded(awkward).collect()
    assert sorted(r["decoded"] for r in rows) == texts and all(r["agrees"] for r in rows)
    assert sorted(r["ids"] for r in rows) == sorted(LIBRARY.encode(texts, add_eos=True))
    assert pieces.encoded(nothing).count() == 0
    again = pieces.decoded(pieces.encoded(awkward, check=False).select("ids", F.lit("x").alias("doc_id"))).collect()
    assert sorted(r["decoded"] for r in again) == texts and {r["doc_id"] for r in again} == {"x"}


# 13 periodic runs ----------------------------------------------------------------------------------------


def plain_runs(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(i + 1, j)
    return sorted(((i, n, q) for (i, n), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=20), st.lists(st.sampled_from("ab"), min_size=1, max_size=8), st.integers(0, 8)), max_size=4),
       st.sampled_from([(24, 3), (2, 2), (6, 2), (10, 4)]))
def test_runs_are_the_plain_ones(parts, limits):
    lists = [[w.encode() for w in before + unit * times + before[:2] + unit * 3] for before, unit, times in parts]
    got = [sorted(map(tuple, r.tolist()), key=lambda r: (r[0], r[2])) for r in repeats.runs_of_texts(lists, *limits)]
    assert got == [plain_runs(words, *limits) for words in lists]


def test_query_rows(spark, awkward, nothing, tmp_path):
    rng = random.Random(5)
    rows = [(i, t) for i, t, _, _ in ROWS] + [(k, " \n".join(rng.choice(["x", "yy", "zé"]) for _ in range(rng.randint(0, 300)))) for k in range(100, 200)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected = []
    for doc_id, text in rows:
        words = repeats.planted(doc_id, (text or "").encode().split())
        runs = plain_runs(words)
        dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        kept = b" ".join(w for k, w in enumerate(words) if k not in dropped).decode()
        expected.append((doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha(lines), sha(kept)))
    assert as_rows(repeats.op13_periodic_runs(spark, str(tmp_path))) == sorted(expected, key=str)
    assert sum(r[1] > 0 for r in expected) >= 5 and repeats.periodic_runs(nothing).count() == 0


def test_a_long_text_of_one_word():
    (runs,) = repeats.runs_of_texts([[b"a"] * 50_000])
    assert runs.tolist() == [[0, 50_000, 1]]
