"""Bottom-k sketches of hashed five-word shingles, in DataFrame functions only.

A text's shingles are its distinct runs of five words (A-Z lower-cased, words as in common.WORD); a text of fewer
words has its whole sequence as one shingle, a text without words none. The sketch is the k least distinct 64-bit
hashes in ascending order, so the sketch of a union is the k least of both sketches. Nulls in text count as empty
texts; two sketches without hashes are alike (1.0), one without is unlike any other (0.0). Documents follow each
other by descending id, null ids last, ties by hash of the text (so repeated rows stand together); after the last
comes the first. Texts of any length count whole; an empty table gives an empty table. Only doc_id and text are read.

Neighbours are found in blocks of the order. An id with many rows has several blocks, by the hash of the text, and a text
of it with many rows has several too, among which its rows, being alike, are dealt at random.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import WORD_SPACE, let, lower_bound, read_table

K, WIDTH = 128, 5
#: Blocks of neighbouring ids a shuffle partition works on, one after another.
BLOCKS = 4
#: Bits of a block's number for the place in a hot text, and as many before them for that in a hot id.
ANY = 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """Hashes of all shingles, repeats included."""
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), WORD_SPACE, -1), lambda w: w != "")

    def rolled(h: Column) -> Column:
        n = F.size(h)
        few = F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.xxhash64(*[F.get(h, i + (k - 1)) for k in range(width)]))
        return F.when(n < width, few).otherwise(many)

    return let(F.transform(words, lambda w: F.xxhash64(w)), rolled)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The k least distinct shingle hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(F.coalesce(text, F.lit("")), width))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated size of the intersection over that of the union: the share of the union's sketch that both hold."""
    both = let(F.array_intersect(a, b), lambda same: let(merged(a, b, k), lambda union: F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(union, same)) / F.size(union))))
    return F.when(a == b, F.lit(1.0)).otherwise(both)


def distinct_estimate(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (s[k - 1].cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds; 0 where a has none."""
    shared = resemblance(a, b, k) * distinct_estimate(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), shared / distinct_estimate(a, k)))


def rendered(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def table_sketch(docs: DataFrame, text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """One row, sketch: the sketch of all shingles of a whole table, from a sketch of each partition's distinct hashes, merged."""
    hashes = docs.select(F.explode(sketch(F.col(text), k, width)).alias("hash"))  # a row's sketch holds all of it that can matter
    parts = hashes.withColumn("part", F.spark_partition_id()).groupBy("part", "hash").agg(F.lit(1)).groupBy("part").agg(F.slice(F.sort_array(F.collect_set("hash")), 1, k).alias("sketch"))
    return parts.agg(F.sort_array(F.array_agg("sketch")).alias("all")).select(F.aggregate("all", F.array().cast("array<bigint>"), lambda acc, x: merged(acc, x, k)).alias("sketch"))


def tie_of(text: Column) -> Column:
    """52 bits of a text's hash, which quantiles hold exactly."""
    return F.shiftright(F.xxhash64(text), 12)


def _isolated(cuts: list[int], hot: dict) -> list[int]:
    """The distinct bounds, a hot value having one at itself and one after it."""
    return sorted({c for c in cuts if c not in hot} | {x for h in hot if h is not None for x in (h, h + 1) if x < 1 << 63})


def _blocks(docs: DataFrame, blocks: int) -> Column:
    """Block of a row (doc_id, tie) as a long: place among the ids, then of a hot id among its ties, then of a hot tie any.

    Bounds are quantiles; an id or text with more than a block's share of the rows is split by its share.
    """
    shares = lambda n: [i / n for i in range(1, n)]
    rows, cuts = docs.agg(F.count("*"), F.percentile_approx("doc_id", shares(blocks), 20 * blocks)).first() if blocks > 1 else (0, None)
    large = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") * blocks > rows).collect() if rows else []
    hot = {r["doc_id"]: -(-r["n"] * blocks // rows) for r in large(docs, "doc_id")}  # at most as many as blocks
    own = docs.where(F.col("doc_id").isin([h for h in hot if h is not None]) | (F.lit(None in hot) & F.col("doc_id").isNull()))
    alike = {(r["doc_id"], r["tie"]): r["n"] for r in large(own, "doc_id", "tie")} if hot else {}
    ties: dict = {}
    for size in sorted({n.bit_length() for n in hot.values()}):  # so that what is collected is twice the blocks at most
        some = own.where(F.coalesce("doc_id", F.lit(0)).isin([h or 0 for h, n in hot.items() if n.bit_length() == size]))
        ties |= {h: [int(x) for x in t] for h, t in some.groupBy("doc_id").agg(F.percentile_approx("tie", shares(1 << size), 20 << size)).collect()}
    first = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(lower_bound(_isolated([int(c) for c in cuts or []], hot), F.col("doc_id")))
    second, third = F.lit(0), F.lit(0)
    for h, found in ties.items():
        many = {t: n for (i, t), n in alike.items() if i == h}
        here = F.col("doc_id").eqNullSafe(F.lit(h).cast("bigint"))
        second = F.when(here, lower_bound(_isolated(found, many), F.col("tie"))).otherwise(second)
        for t, n in many.items():
            parts = min(-(-n * blocks // rows), n // 1000)  # no deal leaves a part empty
            if parts > 1:
                third = F.when(here & (F.col("tie") == t), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")).otherwise(third)
    return (F.lit(1 << 20) - first).cast("bigint") * (1 << 2 * ANY) + second.cast("bigint") * (1 << ANY) + third


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, tie of every document with block, ahead (1: a copy of the next block's first, only to be looked at).

    Each block (but one of several of one text, whose next is of that text) also gets the first rows of the block after it, so the neighbour of every row stands in its own block and one
    exchange of the texts is enough.
    """
    keyed = docs.select("doc_id", "text", tie_of(F.col("text")).alias("tie"))
    key = _blocks(keyed.select("doc_id", "tie"), BLOCKS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), F.col("tie").alias("tie"), F.col("doc_id").alias("id"))
    firsts = {r["key"]: r["first"] for r in keyed.select(key.alias("key"), place.alias("place")).groupBy("key").agg(F.min("place").alias("first")).collect()}
    order = sorted(firsts)
    if not order:
        return docs.select(F.lit(0).alias("block"), F.lit(0).alias("ahead"), "doc_id", "text", F.lit(0).cast("bigint").alias("tie"))
    each = lambda name: F.from_json(F.lit(json.dumps([firsts[k][name] for k in order])), "array<bigint>")
    dealt = keyed.withColumn("_key", key).withColumn("_number", lower_bound(order, F.col("_key")) - 1)
    at = F.col("_number") + 1
    first = F.element_at(each("id"), at).eqNullSafe(F.col("doc_id")) & (F.element_at(each("tie"), at) == F.col("tie")) & (F.col("_key") % (1 << ANY) == 0)
    own = F.struct(F.col("_number").alias("block"), F.lit(0).alias("ahead"))
    seen = F.struct(F.pmod(F.col("_number") - 1, F.lit(len(order))).alias("block"), F.lit(1).alias("ahead"))
    return dealt.withColumn("_to", F.explode(F.when(first, F.array(own, seen)).otherwise(F.array(own)))).select("_to.block", "_to.ahead", "doc_id", "text", "tie")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Digest, sketches and likenesses of every row of docs (doc_id, text) and its edited text."""
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    order = Window.partitionBy("block").orderBy("ahead", F.col("doc_id").desc_nulls_last(), "tie")
    ahead = rows.withColumn("_next", F.coalesce(F.lead("text").over(order), F.col("text")))
    n = F.length("text")
    cut = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("_next").substr(F.lit(1), cut))
    texts = ahead.withColumn("_edited", F.when(F.col("ahead") == 0, edited))
    done = texts.select("block", "ahead", "doc_id", "tie", n.cast("bigint").alias("n_chars"), F.sha2(F.col("_edited"), 256).alias("edited_sha256"), sketch(F.col("text")).alias("_own"), F.when(F.col("ahead") == 0, sketch(F.col("_edited"))).alias("_changed"))
    paired = done.withColumn("_after", F.coalesce(F.lead("_own").over(order), F.col("_own"))).where("ahead = 0")
    return paired.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        rendered(F.col("_own")).alias("fingerprint"),
        rendered(F.col("_changed")).alias("edited_fingerprint"),
        resemblance(F.col("_own"), F.col("_changed")).alias("near_edited"),
        resemblance(F.col("_own"), F.col("_after")).alias("near_next"),
        containment(F.col("_own"), F.col("_changed")).alias("in_edited"),
        distinct_estimate(F.col("_own")).alias("n_shingles_estimate"),
    )


def op4_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
