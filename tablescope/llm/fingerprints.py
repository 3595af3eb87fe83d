"""Operator 8: document fingerprints by I-Match over randomised lexicon subsets, with DataFrame functions only.

The lexicon holds the terms whose share of documents lies in a band, that is, whose inverse document frequency does.
A document's terms in the lexicon are hashed and sorted; each of the randomised subsets of the lexicon (a term is in a
subset by bits of its hash) keeps some of them, and the kept ones are hashed as one.  The fingerprint lists these
hashes.  The likeness of two fingerprints is the share of equal hashes among the subsets that one of them has terms in.
Dense subsets tell near copies from the rest, sparse ones follow how many terms are shared.

A band starting at the share ``least`` bounds the lexicon by (distinct terms of a document, on average) / ``least``
terms, whatever the number of documents; it reaches the driver and goes with the plan as one constant.

Defined results: null texts are empty; a text without a term of the lexicon is fingerprinted by all its terms, and is
like another only if these agree; equal texts have equal fingerprints; rows with equal doc_id follow each other by a
hash of their text; null ids come last; a lone row is its own next document; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tablescope.llm.common import documents

LEAST, MOST = 0.01, 0.2
#: Dense subsets, each with an eighth of the lexicon; ``SPLIT`` of them are split into as many sparse ones.
FAN_OUT, SPLIT = 8, 4
#: What the hash of no terms looks like.
EMPTY = "2A"
BUCKET_ROWS, MOST_BUCKETS, FAN = 1024, 1 << 18, 64


def term_hashes(text: Column) -> Column:
    """Hashes of the distinct terms: lower-cased runs of letters and digits."""
    terms = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.array_distinct(F.transform(terms, lambda t: F.xxhash64(t)))


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> list[int]:
    """Hashes of the terms that between ``least`` and ``most`` of the documents hold, and two at least."""
    total = docs.count()
    held = docs.select(F.explode(term_hashes(F.col("text"))).alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    return [r["h"] for r in held.filter((F.col("n") >= max(2.0, least * total)) & (F.col("n") <= most * total)).select("h").collect()]


def _constant(numbers: list[int], kind: str = "bigint") -> Column:
    """The numbers as one array constant of the plan."""
    return F.from_json(F.lit("[" + ",".join(map(str, sorted(numbers))) + "]"), f"array<{kind}>")


def with_fingerprint(df: DataFrame, text: str, terms: list[int], name: str) -> DataFrame:
    """Adds the fingerprint of a text column: one hash per lexicon subset, EMPTY where the text has no term in it.

    The lowest three bits of a term's hash place it in one of the dense subsets, the next three in a sparse one within
    that.  A text without any term of the lexicon has a single '*' hash of all its terms.
    """
    # As functions over an array, the steps stay apart: Spark would write out elements of a plain array in place.
    places = F.array(*[F.lit(k) for k in range(FAN_OUT)])

    def dealt(hashes: Column, shift: int, use) -> Column:
        return F.transform(places, lambda k: use(F.filter(hashes, lambda h: F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(FAN_OUT - 1)) == k)))

    def hashed(kept_terms: Column) -> Column:
        return F.hex(F.xxhash64(kept_terms))

    own, kept, parts = (f"_{part}_{name}" for part in ("own", "kept", "parts"))
    df = df.withColumn(own, term_hashes(F.col(text)))
    df = df.withColumn(kept, F.array_sort(F.array_intersect(own, _constant(terms))))
    df = df.withColumn(parts, dealt(F.col(kept), 0, lambda p: p))
    sparse = F.flatten(F.transform(F.slice(parts, 1, SPLIT), lambda p: dealt(p, 3, hashed)))
    hashes = F.concat(F.transform(parts, hashed), sparse)
    whole = F.array(F.concat(F.lit("*"), F.hex(F.xxhash64(F.array_sort(own)))))
    return df.withColumn(name, F.when(F.size(kept) > 0, hashes).otherwise(whole)).drop(own, kept, parts)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among subsets with terms; fingerprints of different kinds are unlike."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x == y) & (x != EMPTY)), lambda x: x))
    some = F.size(F.filter(F.zip_with(a, b, lambda x, y: (x != EMPTY) | (y != EMPTY)), lambda x: x))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).when(some == 0, F.lit(1.0)).otherwise(equal / some)


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """How many of the falling ``bounds`` are over the key, by a search that narrows by ``FAN`` at each level; null keys come last."""
    levels = [sorted(bounds, reverse=True)]
    while len(levels[-1]) > FAN:
        levels.append(levels[-1][::FAN])
    found = F.lit(0)
    for k, level in enumerate(reversed(levels)):
        array = F.reverse(_constant(level))
        part = array if k == 0 else F.slice(array, F.greatest(found - 1, F.lit(0)) * FAN + 2, FAN - 1)
        over = F.size(F.filter(part, lambda x: x > key))
        found = over if k == 0 else F.when(found == 0, 0).otherwise((found - 1) * FAN + 1 + over)
    return F.when(key.isNull(), F.lit(len(bounds) + 1)).otherwise(found).cast("int")


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Adds next_<column> from the row that follows by falling doc_id; the first follows the last.

    Rows are dealt into buckets of neighbouring ids; within one, a window sees the next row.  The last row of a bucket
    takes the first of the next bucket, which one scan fetches by its id.
    """
    total = rows.count()
    cuts = max(0, min(MOST_BUCKETS, total // BUCKET_ROWS) - 1)
    bounds = sorted(set(map(int, rows.stat.approxQuantile("doc_id", [(k + 1) / (cuts + 1) for k in range(cuts)], 1 / (8 * (cuts + 1)))))) if cuts else []
    dealt = rows.withColumns({"bucket": bucket_of(F.col("doc_id"), bounds), "tie": F.xxhash64("text")})
    order = [F.desc_nulls_last("doc_id"), F.col("tie")]
    inside = Window.partitionBy("bucket").orderBy(*order)
    seen = dealt.withColumns({f"next_{c}": F.lead(c).over(inside) for c in carried} | {"last": F.lead(F.lit(False), 1, True).over(inside)})
    heads = dealt.groupBy("bucket").agg(F.max("doc_id").alias("head"))
    along = Window.orderBy("bucket")
    heads = heads.withColumn("before", F.coalesce(F.lag("bucket").over(along), F.max("bucket").over(Window.partitionBy())))
    first = dealt.join(F.broadcast(heads), (dealt["bucket"] == heads["bucket"]) & dealt["doc_id"].eqNullSafe(heads["head"]))
    first = first.groupBy("before").agg(F.min_by(F.struct(*carried), "tie").alias("first"))
    joined = seen.join(first.withColumnRenamed("before", "bucket").withColumn("last", F.lit(True)), ["bucket", "last"], "left")
    taken = {f"next_{c}": F.when(F.col("last"), F.col(f"first.{c}")).otherwise(F.col(f"next_{c}")) for c in carried}
    return joined.withColumns(taken).drop("bucket", "tie", "last", "first")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint (array of hashes) of every document."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return with_fingerprint(own, "text", lexicon(own), "fingerprint").select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fingerprint")


def op8_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    terms = lexicon(own)
    rows = with_next(with_fingerprint(own, "text", terms, "fp"), ["text", "fp"])
    size = F.char_length("text")
    half = F.floor(size / 2).cast("int")
    rows = rows.withColumns({"n_chars": size.cast("long"), "edited": F.concat(F.substring("text", F.lit(1), size - half), F.substring("next_text", F.lit(1), half))})
    rows = with_fingerprint(rows.select("doc_id", "n_chars", "fp", "next_fp", "edited"), "edited", terms, "edited_fp")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.array_join("fp", ".").alias("fingerprint"),
                       F.array_join("edited_fp", ".").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                       likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


QUERIES = {"op8_imatch": op8_imatch}
ORACLES: dict = {}
