"""Operator 5: chat formatting after collapsing cumulative snapshots.

Logs often hold a conversation again and again, each time with more turns.  Every turn gets a hash of all turns up to
it: a running exclusive-or of turn hashes that include their place.  A conversation whose last hash is that of an inner
turn of another one is a prefix of it and leaves by an anti-join; of equal conversations the smallest conv_id stays.
What is left is rendered, turn by turn, between marks.

Role and text become two hashes in the scan, and the windows and joins of the search carry only these.  Turns that share
their number but not their content are ranked by their texts.  The texts of the maximal conversations come in at the end
by one join.  Turns are placed and hashed in blocks of ``BLOCK`` turn numbers with one row per block to carry on, so that
a very long conversation is not one task's window; prefixes are made distinct before they meet, so that a common first
turn is one row per task.  Hashes have 128 bits.  A rendered conversation is one value and has to fit into a task.

Defined results: turns are ordered by turn, then role and text (nulls first); a missing role is ``unknown`` and a missing
text empty; equal turns count each for itself; turns without conv_id are one conversation; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablescope.llm.common import documents, small, stored

BLOCK = 4096
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Hashes of what a turn says, and which of role and text are missing.
CONTENT = ("h", "g", "gaps")


def _keyed(turns: DataFrame) -> DataFrame:
    """conv and turn as structs, in which nulls are equal, role and text."""
    return turns.select(F.struct("conv_id").alias("conv"), F.struct("turn").alias("turn"), "role", "text")


def _said(role: Column | str, text: Column | str) -> tuple[Column, Column]:
    return F.coalesce(role, F.lit("unknown")), F.coalesce(text, F.lit(""))


def _hashed(rows: DataFrame, *more: str) -> DataFrame:
    role, text = _said("role", "text")
    gaps = 2 * F.isnull("role").cast("int") + F.isnull("text").cast("int")
    return rows.select("conv", "turn", *more, F.xxhash64(role, text).alias("h"), F.xxhash64(F.lit("second"), text, role).alias("g"), gaps.alias("gaps"))


def _ranked(turns: DataFrame) -> DataFrame:
    """conv, turn, h, g and the rank of the content among those of the same turn."""
    rows = _keyed(turns)
    hashed = stored(_hashed(rows))
    content = F.struct(*CONTENT)
    several = hashed.groupBy("conv", "turn").agg((F.min(content) != F.max(content)).alias("several")).filter("several").select("conv", "turn")
    tied = rows.join(small(several), ["conv", "turn"]).distinct()
    ranks = _hashed(tied.withColumn("rank", F.row_number().over(Window.partitionBy("conv", "turn").orderBy("role", "text"))), "rank")
    found = hashed.join(small(ranks), ["conv", "turn", *CONTENT], "left")
    return found.select("conv", "turn", "h", "g", F.coalesce("rank", F.lit(0)).alias("rank"))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv, place (from 1), turns (of the conversation) and the hashes p, q of all turns up to each."""
    rows = _ranked(turns).withColumn("block", F.floor(F.coalesce("turn.turn", F.lit(-1)) / BLOCK))
    along = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(F.count("*").alias("held"))
    blocks = blocks.select("conv", "block", F.coalesce(F.sum("held").over(along), F.lit(0)).alias("before"),
                           F.sum("held").over(Window.partitionBy("conv")).alias("turns"))
    inside = Window.partitionBy("conv", "block").orderBy("turn", "rank", "h", "g")
    rows = rows.withColumn("at", F.row_number().over(inside)).join(blocks, ["conv", "block"])
    place = F.col("before") + F.col("at")
    rows = rows.select("conv", "block", place.alias("place"), "turns", F.xxhash64(place, "h").alias("h"), F.xxhash64(F.lit("second"), "g", place).alias("g"))
    carried = rows.groupBy("conv", "block").agg(F.bit_xor("h").alias("h"), F.bit_xor("g").alias("g"))
    carried = carried.select("conv", "block", *[F.coalesce(F.bit_xor(n).over(along), F.lit(0).cast("long")).alias(f"before_{n}") for n in "hg"])
    so_far = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    p, q = (F.bit_xor(n).over(so_far) for n in "hg")
    rows = rows.withColumns({"p": p, "q": q}).join(carried, ["conv", "block"])
    return rows.select("conv", "place", "turns", F.col("p").bitwiseXOR(F.col("before_h")).alias("p"), F.col("q").bitwiseXOR(F.col("before_g")).alias("q"))


def maximal(hashes: DataFrame) -> DataFrame:
    """conv, turns and copies of the conversations that prefix no longer one, one of each equal group."""
    last = hashes.filter("place = turns").groupBy("turns", "p", "q").agg(F.min("conv.conv_id").alias("conv_id"), F.count("*").alias("copies"))
    inner = hashes.filter("place < turns").select(F.col("place").alias("turns"), "p", "q").distinct()
    return last.join(inner, ["turns", "p", "q"], "left_anti").select(F.struct("conv_id").alias("conv"), "turns", "copies")


def rendered(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies and text of the maximal conversations."""
    kept = maximal(stored(prefix_hashes(turns)))
    rows = _keyed(turns).join(kept, "conv")
    chats = rows.groupBy("conv", "turns", "copies").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))

    def one(turn: Column) -> Column:
        role, text = _said(turn["role"], turn["text"])
        return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE + "\n"))

    return chats.select("conv.conv_id", F.col("turns").alias("n_turns"), "copies", F.array_join(F.transform("all", one), "").alias("text"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(documents(spark, sf_dir, "conversations"))


_SQL = f"""
with t as (select conv_id, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
  row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as place, count(*) over (partition by conv_id) as n from conversations),
p as (select conv_id, place, n, string_agg('{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10), '') over (partition by conv_id order by place) as s from t),
whole as (select min(conv_id) as conv_id, n, count(*) as copies, s from p where place = n group by n, s)
select conv_id, n as n_turns, copies, s as text from whole w where not exists (select 1 from p where p.place = w.n and p.n > p.place and p.s = w.s)"""


QUERIES = {"op5_chat_format": op5_chat_format}
ORACLES = {"op5_chat_format": _SQL}
