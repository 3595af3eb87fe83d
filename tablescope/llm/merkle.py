"""Operator 11: Merkle dataset manifest, with proofs by pointer jumping.

A leaf is the hash of a document's fields.  Leaves of one language, by doc_id, are the leaves of a binary tree; the
trees' roots, by language, are the leaves of a last tree, whose root stands for the table.  A level's nodes are hashed
two by two; the last one alone is hashed too, until one node is left.

Trees rise in passes of ``BITS`` levels: a pass hashes aligned runs of 2**BITS nodes, each in one group, so that no tree
is ever whole in a task.  Every node holds the segment (side and sibling) to its parent.  Then distances double: nodes
at every 2d-th level take over the segment of the ancestor d levels above, by a self-join on (tree, level, place), and
hold 2d levels; leaves join the ancestor at level d in the same round and reach the root after log2(height) rounds.

Defined results: null fields are '-'; documents without a language come first, and so do null ids; rows of one doc_id
are ordered by their hash, and equal rows are leaves of their own; a lone leaf is its tree's root and has an empty
proof; an empty table has no rows and no root; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tablescope.llm.common import documents, fold, small, stored
from tablescope.operators.rows import numbered_rows

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one pass builds.
BITS = 10
#: A step of a proof: one byte (0 no sibling, 1 sibling on the right, 2 on the left), then the sibling's 32 bytes or zeros.
STEP = 33
_ALONE = bytes(STEP)
#: Bytes of ancestors that may be broadcast to meet the leaves.
BROADCAST_BYTES = 8_000_000


def leaf_hash(changes: dict[str, Column] | None = None) -> Column:
    """Hash of a document's fields: '-' for null, else its UTF-8 byte count, ':' and the value."""
    def part(name: str) -> Column:
        value = (changes or {}).get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[part(name) for name in FIELDS]), 256)


def levels_above(n: int) -> int:
    """Levels from n nodes to one."""
    return (n - 1).bit_length()


def parent(left: bytes, right: bytes | None) -> bytes:
    return hashlib.sha256((left.hex() + (right.hex() if right else "")).encode()).digest()


def _run_up(table: pa.Table, bits: int) -> pa.Table:
    """One aligned run of a level's nodes and all nodes above it that the pass builds.

    Rows with a segment are nodes below the pass's top (level counts from the run's own); the row without one is the top.
    """
    table = table.sort_by("at")
    tree, first, n = table["tree"][0], table["at"][0].as_py(), table["n"][0].as_py()
    nodes = table["digest"].to_pylist()
    size, height = len(nodes), min(bits, levels_above(n))
    rows: list[tuple] = []
    for level in range(height):
        for k, node in enumerate(nodes):
            other = k ^ 1
            step = _ALONE if other >= len(nodes) else bytes([1 + k % 2]) + nodes[other]
            rows.append((level, first + k, node, step))
        nodes = [parent(*nodes[k : k + 2], *[None] * (k + 1 == len(nodes))) for k in range(0, len(nodes), 2)]
        first >>= 1
    if height == 0:
        rows.append((0, first, nodes[0], b""))
    rows.append((height, first, nodes[0], None))
    level, at, digest, segment = zip(*rows)
    here = pa.array([k if k < size else None for k in range(len(rows))], pa.int64())
    return pa.table({
        "tree": pa.array([tree.as_py()] * len(rows), pa.int64()), "rise": pa.array(level, pa.int64()), "at": pa.array(at, pa.int64()),
        "n": pa.array([n] * len(rows), pa.int64()), "digest": pa.array(digest, pa.binary()), "segment": pa.array(segment, pa.binary()),
        "item": pc.take(table["item"].combine_chunks(), here)})


def forest(leaves: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """All nodes below a root (tree, level, at, digest, segment, item) and the roots (tree, digest).

    ``leaves`` has tree, at (place in the tree, from 0), n (leaves of the tree), digest and item, which stays with leaves.
    """
    item = leaves.schema["item"].dataType.simpleString()
    schema = f"tree long, rise long, at long, n long, digest binary, segment binary, item {item}"
    most = leaves.agg(F.max("n")).first()[0] or 1
    width, found, roots, base = 1 << bits, None, None, 0
    while True:
        runs = leaves.groupBy("tree", F.shiftright("at", bits).alias("run"))
        rows = stored(runs.applyInArrow(lambda table: _run_up(table, bits), schema))
        below = rows.filter("segment is not null").select("tree", (F.col("rise") + base).alias("level"), "at", "digest", "segment", "item")
        tops = rows.filter("segment is null")
        ended = tops.filter(F.col("n") <= width).select("tree", "digest")
        found, roots = (below, ended) if found is None else (found.unionByName(below), roots.unionByName(ended))
        if most <= width:
            return found, roots
        left = F.floor((F.col("n") + (width - 1)) / width).cast("long").alias("n")
        leaves = tops.filter(F.col("n") > width).select("tree", "at", left, "digest", F.lit(None).cast(item).alias("item"))
        most, base = -(-most // width), base + bits


def with_paths(nodes: DataFrame) -> DataFrame:
    """tree, at, digest, item and path (the steps to the tree's root) of every leaf, by doubling distances."""
    sizes = {r["level"]: r["count"] for r in nodes.groupBy("level").count().collect()}
    height = max(sizes, default=0) + 1
    leaves = nodes.filter("level = 0").select("tree", "at", "digest", "item", F.col("segment").alias("path"))
    live = nodes.filter("level > 0").select("tree", "level", "at", F.col("segment").alias("path"))
    d = 1
    while d < height:
        above = live.filter(F.col("level") % (2 * d) == d).select(
            F.col("tree").alias("_tree"), F.col("level").alias("_level"), F.col("at").alias("_at"), F.col("path").alias("_more"))
        reached = above.filter(F.col("_level") == d)
        if sizes.get(d, 0) * d * STEP <= BROADCAST_BYTES:
            reached = F.broadcast(reached)
        leaves = _joined(leaves, reached, (F.col("tree") == F.col("_tree")) & (F.shiftright("at", d) == F.col("_at")))
        if 2 * d < height:
            on = (F.col("tree") == F.col("_tree")) & (F.col("level") + d == F.col("_level")) & (F.shiftright("at", d) == F.col("_at"))
            live = stored(_joined(live.filter(F.col("level") % (2 * d) == 0), above, on))
        d *= 2
    return leaves


def _joined(rows: DataFrame, above: DataFrame, on: Column) -> DataFrame:
    """Rows whose path goes on with that of the ancestor it ends at; rows already at the root stay as they are."""
    path = F.concat("path", F.coalesce("_more", F.lit(b"")))
    return rows.join(above, on, "left").withColumn("path", path).select(*rows.columns)


def manifest(docs: DataFrame, extra: Column | None = None, bits: int = BITS) -> DataFrame:
    """doc_id, leaf, subroot, root and path (steps from leaf to root) of every document; ``extra`` is carried along."""
    rows = stored(docs.select("doc_id", "lang", F.unhex(leaf_hash()).alias("digest"), (F.lit(None) if extra is None else extra).cast("string").alias("extra")))
    # Equal rows are one range of the sort unless something tells them apart; which of them comes first is all the same.
    order = [F.col("lang").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("copy")]
    numbered = numbered_rows(rows.withColumn("copy", F.monotonically_increasing_id()), order)
    trees = stored(numbered.groupBy("lang").agg(F.min("row_number").alias("tree"), F.count(F.lit(1)).alias("n")))
    own = numbered.alias("r").join(small(trees.withColumnRenamed("lang", "of")), F.col("lang").eqNullSafe(F.col("of")))
    own = own.select("tree", (F.col("row_number") - F.col("tree")).alias("at"), "n", "digest", F.struct("doc_id", "extra").alias("item"))
    nodes, subroots = forest(own, bits)
    among = numbered_rows(subroots, [F.col("tree")])
    count = among.count()
    nodes_above, roots = forest(among.select(
        F.lit(0).cast("long").alias("tree"), (F.col("row_number") - 1).alias("at"), F.lit(count).cast("long").alias("n"), "digest", F.col("tree").alias("item")), bits)
    root = roots.first()
    upper = with_paths(nodes_above).select(F.col("item").alias("tree"), F.col("digest").alias("_subroot"), F.col("path").alias("_upper"))
    found = with_paths(nodes).join(small(upper), "tree")
    return found.select(
        "item.doc_id", _hex("digest").alias("leaf"), _hex("_subroot").alias("subroot"),
        F.lit(root["digest"].hex() if root else None).cast("string").alias("root"), F.concat("path", "_upper").alias("path"), "item.extra")


def _hex(column) -> Column:
    return F.lower(F.hex(column))


def steps(path: Column) -> Column:
    """The steps of a path: structs of side and sibling (hex, '' for none)."""
    count = F.floor(F.octet_length(path) / STEP)

    def step(k: Column) -> Column:
        side = F.hex(F.substring(path, k * STEP + 1, F.lit(1))).cast("int")
        return F.struct(side.alias("side"), F.when(side > 0, _hex(F.substring(path, k * STEP + 2, F.lit(STEP - 1)))).otherwise("").alias("sibling"))

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), step)).otherwise(F.array().cast("array<struct<side:int,sibling:string>>"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the steps of its proof give."""
    def up(node: Column, s: Column) -> Column:
        return F.sha2(F.when(s["side"] == 2, F.concat(s["sibling"], node)).otherwise(F.concat(node, s["sibling"])), 256)

    return F.aggregate(proof, leaf, up)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and each proof folded anew from the leaf; some leaves are tampered with, as the contract says."""
    docs = documents(spark, sf_dir)
    tampered = F.when(fold("doc_id", 7) == 0, leaf_hash({"n_chars": F.col("n_chars") + 1}))
    proof = manifest(docs, tampered).withColumn("proof", steps(F.col("path")))
    out = proof.withColumn("folded_root", folded(F.coalesce("extra", "leaf"), F.col("proof")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(F.col("proof.sibling"), ""), 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
ORACLES: dict = {}
