"""The links of operator 2, once each: pairs of classes, and the number of links of every document.

All links lie within components, which ``jaccard`` finds without forming all pairs.  Each component's classes are dealt
by hash into blocks bounded in tokens and classes, and each pair of blocks is one group, which a matrix product over the
shared tokens compares; so each pair of classes is verified once, a large component is spread over many tasks, and none
of its pairs is left out.  Components of one block are bundled.  Counts leave a group added up by class, so that their
rows grow with the classes times the blocks of a component, not with its pairs.

Defined results: documents of one class (equal sets) are linked to each other; null and empty texts have no link; a
repeated row is a document of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablescope.llm.common import documents, stored
from tablescope.llm.jaccard import PERCENT, WORDS, Classes, classes_of

#: Tokens and classes of a block, on average, and the columns of a matrix at once.
BLOCK_TOKENS, BLOCK_CLASSES, COLUMNS = 400_000, 1_000, 4_096


def _overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Common tokens of each set of x with each of y."""
    def placed(sets: list[np.ndarray], shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, tokens = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(shared, tokens), len(shared) - 1)
        known = shared[at] == tokens
        order = np.argsort(at[known], kind="stable")
        return rows[known][order], at[known][order]

    shared = np.intersect1d(np.concatenate(x), np.concatenate(y))
    out = np.zeros((len(x), len(y)), dtype=np.float32)  # exact up to 2^24 tokens a set
    if len(shared):
        (rows_x, at_x), (rows_y, at_y) = placed(x, shared), placed(y, shared)
        for low in range(0, len(shared), COLUMNS):
            parts = []
            for rows, at, size in ((rows_x, at_x, len(x)), (rows_y, at_y, len(y))):
                begin, end = np.searchsorted(at, [low, low + COLUMNS])
                part = np.zeros((size, min(COLUMNS, len(shared) - low)), dtype=np.float32)
                part[rows[begin:end], at[begin:end] - low] = 1
                parts.append(part)
            out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _links_in(group: pd.DataFrame, percent: int) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]]:
    """For each component of a group: two blocks and the places of linked classes in them, each pair once."""
    for _, own in group.groupby("component", sort=False):
        i, j = own["i"].iloc[0], own["j"].iloc[0]
        x = own[own["block"] == i]
        y = x if i == j else own[own["block"] == j]
        if not len(x) or not len(y):
            continue
        common = _overlaps(list(x["shingles"]), list(y["shingles"]))
        sizes = x["n"].to_numpy()[:, None] + y["n"].to_numpy()[None, :]
        like = 100 * common >= percent * (sizes - common)
        yield x, y, *np.nonzero(np.triu(like, 1) if i == j else like)


def _in_groups(found: Classes, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` on every pair of blocks of every component."""
    held = stored(found.sets.join(found.component, "class").join(found.classes.select("class", "copies"), "class"))
    sizes = held.groupBy("component").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("k"))
    sizes = sizes.withColumn("blocks", F.ceil(F.greatest(F.col("tokens") / BLOCK_TOKENS, F.col("k") / BLOCK_CLASSES)).cast("int"))
    bundles = max(1, int(held.agg(F.sum("n")).first()[0] or 0) // BLOCK_TOKENS)
    dealt = held.join(sizes.select("component", "blocks"), "component")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("class", F.lit("block")), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    one = F.pmod(F.xxhash64("component", F.lit("bundle")), F.lit(bundles))
    dealt = dealt.select("component", "class", "n", "copies", "shingles", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                         F.when(F.col("blocks") == 1, one).otherwise(F.col("component")).alias("held_by"), (F.col("blocks") > 1).alias("large"))
    return dealt.groupBy("large", "held_by", "i", "j").applyInPandas(run, schema)


def class_links(found: Classes, percent: int = PERCENT) -> DataFrame:
    """a and b of every linked pair of classes, once (a < b); with ``found.rows``, the classes of the documents, all links."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        pairs = [(x["class"].to_numpy()[r], y["class"].to_numpy()[c]) for x, y, r, c in _links_in(group, percent)]
        a, b = (np.concatenate([np.zeros(0, dtype=np.int64), *(p[k] for p in pairs)]) for k in (0, 1))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return _in_groups(found, run, "a long, b long")


def link_counts(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and n_links, the number of other documents that each document is linked to."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for x, y, r, c in _links_in(group, percent):
            keys += [x["class"].to_numpy()[r], y["class"].to_numpy()[c]]
            counts += [y["copies"].to_numpy()[c], x["copies"].to_numpy()[r]]
        classes, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(classes), dtype=np.int64)
        np.add.at(sums, at, np.concatenate(counts))
        return pd.DataFrame({"class": classes, "links": sums})

    found = classes_of(docs, words, percent)
    others = _in_groups(found, run, "class long, links long").groupBy("class").agg(F.sum("links").alias("links"))
    counts = found.classes.select("class", "copies").join(others, "class", "left").select("class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = found.rows.filter("n > 0").join(counts, "class").select("doc_id", F.col("n").alias("n_shingles"), "n_links")
    return out.unionByName(found.rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_links")))


def op2_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_counts(documents(spark, sf_dir), 4, 85)


def _sql(words: int = 4, percent: int = 85) -> str:
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= {words} then [{shingle} for i in range(1, len(w) - {words - 2})] when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (select x.doc_id as a, y.doc_id as b, count(*) as o from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by 1, 2),
e as (select a, count(*) as k from o join n nx on nx.doc_id = a join n ny on ny.doc_id = b where 100 * o >= {percent} * (nx.n + ny.n - o) group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(e.k, 0) as n_links
from d left join n on n.doc_id = d.doc_id left join e on e.a = d.doc_id"""


QUERIES = {"op2_ngram_jaccard_links": op2_ngram_jaccard_links}
ORACLES = {"op2_ngram_jaccard_links": _sql()}
