"""Operator 1: mixing sources to target weights, with DataFrame functions only.

The words of a source, document after document, form a stream that is packed into blocks of ``block`` words.  The mix
is a row of slots, cut into output shards.  Each slot draws a source: slot numbers are permuted and read against the
cumulative slot counts of the sources.  The counts in a shard are thus multinomial draws given their totals, so that
sources meet their targets exactly (independent draws would miss them by the square root of the slots, and could pass
the limit of two passes).  The j-th slot of a source takes block permutation(j) of the pass j belongs to: every block
once in a pass.  Slots and blocks are joined by source and block number.

Permutations are swap-or-not shuffles, made of hashes: no sort, and reruns agree.  Places in a stream are prefix sums
in two steps, over buckets of about the square root of all rows, so that a hot source has many buckets.

Defined results: null texts have size 0; null sources are one source, ordered last; documents without words take 0;
repeated rows are documents of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablescope.llm.common import WORD, documents, small, stored, with_row_key

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Words of a block, slots of an output shard, rounds of a permutation, slots made by one row.
BLOCK, SHARD_SLOTS, ROUNDS, CHUNK = 128, 8192, 12, 4096


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """Pseudorandom permutation of 0..n-1 (swap-or-not: each round may swap x with key - x)."""
    size = F.greatest(n, F.lit(1))

    def swap(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(r, *key), size) - at, size)
        return F.when(F.xxhash64(F.greatest(at, other), r, *key) % 2 == 0, other).otherwise(at)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), x.cast("long"), swap)


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, sid (place by code point, null last), source_size and target.

    Sorted by limit per weight, the sources up to some place stop at their limit and the rest share what is left by
    weight; the first place whose share is within its limit is the right one.  One row per source.
    """
    everything = Window.orderBy(F.col("source").isNull(), "source")
    rising = Window.orderBy("ratio", "sid")
    rest = rising.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(everything).cast("long") - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights)).cast("int") + 1)
    s = s.withColumns({"weight": weight, "limit": F.col("source_size") * float(most), "total": F.sum("source_size").over(whole) * float(share)})
    s = s.withColumn("ratio", F.col("limit") / F.col("weight"))
    s = s.withColumns({"stopped": F.sum("limit").over(rising) - F.col("limit"), "left": F.sum("weight").over(rest), "at": F.row_number().over(rising)})
    s = s.withColumn("level", (F.col("total") - F.col("stopped")) / F.col("left"))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(whole)["level"])
    return s.select("source", "sid", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), "limit")).alias("target"))


def with_slots(sources: DataFrame, block: int) -> DataFrame:
    """Adds full blocks, tail, whole passes, the rest's blocks and words, slots and the first slot of each source."""
    goal, size = F.round("target").cast("long"), F.col("source_size")
    s = sources.withColumns({"blocks": F.floor(size / block), "tail": size % block, "passes": F.when(size > 0, F.floor(goal / size)).otherwise(F.lit(0))})
    s = s.withColumn("rest", goal - F.col("passes") * size)
    s = s.withColumn("rest_blocks", F.floor(F.col("rest") / block))
    per_pass = F.col("blocks") + F.when(F.col("tail") > 0, 1).otherwise(0)
    s = s.withColumns({"per_pass": per_pass, "slots": F.col("passes") * per_pass + F.col("rest_blocks") + F.when(F.col("rest") % block > 0, 1).otherwise(0)})
    return s.withColumns({"first_slot": F.sum("slots").over(Window.orderBy("sid")) - F.col("slots"), "all_slots": F.sum("slots").over(Window.partitionBy())})


def mix_slots(sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 0) -> DataFrame:
    """shard, place (in the shard), sid, pass, block, words (of the block's start) of every slot of the mix."""
    total = sources.agg(F.sum("slots")).first()[0] or 0
    keep = ["sid", "blocks", "rest", "passes", "per_pass", "slots", "first_slot", "all_slots"]
    chunks = sources.filter("slots > 0").select(*keep, F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / CHUNK))).alias("chunk"))
    chunks = chunks.repartition(max(1, min(4096, math.ceil(total / CHUNK))), "sid", "chunk")
    j, low = F.col("j"), F.col("chunk") * CHUNK
    slots = chunks.select(*keep, F.explode(F.sequence(low, F.least(low + CHUNK, F.col("slots")) - 1)).alias("j"))
    slots = slots.withColumn("pass", F.least(F.floor(j / F.col("per_pass")), "passes"))
    slots = slots.withColumn("at", j - F.col("pass") * F.col("per_pass"))
    number = F.when(F.col("at") < F.col("blocks"), permuted(F.col("at"), F.col("blocks"), F.lit(seed), F.col("sid"), F.col("pass"))).otherwise(F.col("at"))
    words = F.when(F.col("pass") < F.col("passes"), F.lit(block)).otherwise(F.least(F.lit(block), F.col("rest") - F.col("at") * block))
    place = permuted(F.col("first_slot") + j, F.col("all_slots"), F.lit(seed), F.lit("shards"))
    return slots.select(F.floor(place / shard_slots).alias("shard"), (place % shard_slots).alias("place"), "sid", "pass", number.alias("block"), words.cast("long").alias("words"))


def shard_counts(slots: DataFrame) -> DataFrame:
    """Slots of each source in each output shard: the multinomial draws."""
    return slots.groupBy("shard", "sid").agg(F.count("*").alias("slots"))


def placed(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds sid, source_size, target and ``start``, the words of the source's stream before each document."""
    buckets = max(1, math.isqrt(sizes.count()))
    s, t = sizes.alias("s"), small(sources.select(F.col("source").alias("of"), "sid", "source_size", "target"))
    rows = s.join(t, F.col("s.source").eqNullSafe(F.col("of"))).drop("of").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    ahead = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("held"))
    ahead = ahead.select("sid", "bucket", (F.sum("held").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("held")).alias("before"))
    order = [c for c in ("doc_id", "size", "row_file", "row_at") if c in rows.columns]
    inside = Window.partitionBy("sid", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start", F.sum("size").over(inside) - F.col("size"))
    return rows.join(ahead, ["sid", "bucket"]).withColumn("start", F.col("start") + F.col("before")).drop("bucket", "before")


def mixed_pieces(rows: DataFrame, slots: DataFrame, block: int) -> DataFrame:
    """Each row's stretch of each block, joined with the slots that take the block.

    Adds pass, from_word (in the document) and words; rows whose blocks nothing takes have words 0.
    """
    covers = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    pieces = rows.filter("size > 0").withColumn("block", F.explode(covers))
    low = F.greatest(F.col("start"), F.col("block") * block)
    pieces = pieces.withColumns({"low": low, "high": F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)})
    # Spark takes exploded rows for as few as their source and would broadcast the slots.
    of_slots = slots.select("sid", "block", "pass", F.col("words").alias("of_block")).hint("merge")
    joined = pieces.join(of_slots, ["sid", "block"], "left")
    got = F.least("high", F.col("block") * block + F.coalesce("of_block", F.lit(0))) - F.col("low")
    return joined.withColumns({"from_word": F.col("low") - F.col("start"), "words": F.greatest(got, F.lit(0))}).drop("low", "high", "of_block", "block")


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sizes = stored(sizes_of(docs))
    sources = stored(with_slots(source_targets(sizes), block))
    rows = placed(sizes, sources).select("sid", "doc_id", "size", "source_size", "target", "start")
    out = ["doc_id", "size", "source_size", "target"]
    taken = mixed_pieces(rows, mix_slots(sources, block, seed=seed), block).groupBy("sid", "start", *out).agg(F.sum("words").alias("taken"))
    none = rows.filter("size = 0").select(*out, F.lit(0).cast("long").alias("taken"))
    return taken.select(*out, "taken").unionByName(none)


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The mix as documents: a row per document and pass with the words taken, all columns kept.

    A document taken whole keeps its text; otherwise the taken stretches are joined.  n_chars follows if it is there.
    Every row is a document of its own, also among equal rows.  Documents without words are left out.
    """
    # As one column, the documents' columns cannot meet names used here.
    own = with_row_key(docs)
    size = F.coalesce(F.regexp_count("row.text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    sizes = stored(own.select("row.doc_id", "row.source", size, "row_file", "row_at"))
    sources = stored(with_slots(source_targets(sizes), block))
    rows = placed(sizes, sources).select("sid", "row_file", "row_at", "size", "start")
    pieces = mixed_pieces(rows, mix_slots(sources, block, seed=seed), block).filter("words > 0")
    stretches = F.array_sort(F.collect_list(F.struct("from_word", "words"))).alias("stretches")
    plan = pieces.groupBy("row_file", "row_at", "size", "pass").agg(F.sum("words").alias("taken"), stretches)
    joined = own.join(plan, ["row_file", "row_at"])
    all_words = F.regexp_extract_all("row.text", F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1))
    joined = joined.withColumn("all_words", F.when(F.col("taken") < F.col("size"), all_words))
    cut = F.aggregate("stretches", F.lit(""), lambda a, s: F.concat(a, F.array_join(F.slice("all_words", (s["from_word"] + 1).cast("int"), s["words"].cast("int")), "")))
    text = F.when(F.col("taken") < F.col("size"), cut).otherwise(F.col("row.text"))
    changed = {"text": text} | ({"n_chars": F.char_length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


QUERIES = {"op1_source_mix": op1_source_mix}
ORACLES: dict = {}
