"""Mixing sources to target weights along a time-varying curriculum.

Each source's documents stand in a fixed shuffled order (md5 of the id and of the text) and are read round and round
until the source's target is used up. A source's weight changes over the training time t in [0, 1] as
target * (1 + slope * (1 - 2 t)), which integrates to the target; inverting that integral at the words that the
source gave before a document is the document's training position, and documents are range-sorted by it.

The words before a document are a running sum over the rows in order of source and shuffled order, range-partitioned, so
neither a hot source nor a hot id is in one task: each partition sums its own rows, and the partitions' totals are added up.

Nulls: a null text has no words, a null source is a source of its own (the last), a null id is shuffled as an empty
string. Documents without words are never taken. Rows with the same id and text are mixed each on its own and are
interchangeable. Texts of any length count whole. An empty table gives an empty table. Other columns pass through,
whatever their names; only those named like an output of mix() are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from gridloom.llm.common import WORD, materialize, others, read_table, tidy

WEIGHTS = (3, 1, 2)
#: Slope of each weight's schedule: early, late, level.
SLOPES = (0.5, -0.5, 0.0)
SHARE, CAP = 1.5, 2


def _ranked(sources: DataFrame) -> DataFrame:
    """sources (source, source_size) with place, from 0 by code point, null last; no task sees all sources."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = materialize(sources.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    before, at = {}, 0
    for part in sorted(counts):
        before[part] = at
        at += counts[part]
    base = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_part")) if before else F.lit(0)
    return ranged.withColumn("place", base + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).drop("_part")


def water_level(sources: DataFrame, share: float = SHARE, cap: int = CAP) -> float:
    """Words a unit of weight gets when what is above the caps is reshared by weight until nothing is."""
    level = 0.0
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        capped = cap * F.col("source_size") < F.lit(level) * F.col("weight")
        full, open_weight = sources.agg(F.sum(F.when(capped, cap * F.col("source_size"))), F.sum(F.when(~capped, F.col("weight")))).first()
        found = (share * total - (full or 0)) / open_weight if open_weight else level
        if found <= level:
            return level
        level = found


def _running(batches):
    """Each row with the sizes of the rows of its source before it in this partition, which is sorted by source."""
    import pandas as pd
    import pyarrow as pa

    last, carried = object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sources = batch.column("source").to_pandas()
        size = batch.column("size").to_numpy()
        group = pd.factorize(sources, use_na_sentinel=False)[0]
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        total = np.cumsum(size)
        before = total - size
        before -= np.repeat(before[first], np.diff(np.r_[first, len(size)]))
        name = batch.column("source")[0].as_py()
        if name == last:
            before[: first[1] if len(first) > 1 else len(size)] += carried
        last, carried = batch.column("source")[-1].as_py(), int(before[-1] + size[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before)], [*batch.schema.names, "before"])


@tidy
def mix(docs: DataFrame, weights=WEIGHTS, slopes=SLOPES, share: float = SHARE, cap: int = CAP, keep: list[str] | None = None) -> DataFrame:
    """docs (doc_id, source, text, ...), all columns or those in keep, with size, source_size, target, taken, positions: one
    training position for each time the document is taken, in [0, 1), ascending; taken counts words, the last time may be
    cut short. order is the shuffled order."""
    own = ("size", "source_size", "target", "taken", "positions", "order")
    kept = others(docs.columns if keep is None else keep, own)
    text = F.coalesce("text", F.lit(""))
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(text.cast("binary"))).cast("binary"))
    keyed = docs.select(F.struct(*[f"`{c}`" for c in kept]).alias("row"), "source", F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), order.alias("order"), F.monotonically_increasing_id().alias("place"))
    by = ["source", "order", "place"]
    ranged = keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop("place").withColumn("part", F.spark_partition_id())
    summed = materialize(ranged.mapInArrow(_running, StructType([*ranged.schema.fields, StructField("before", LongType())])))
    blocks = materialize(summed.groupBy("source", "part").agg(F.sum("size").alias("words")))
    sources = _ranked(blocks.groupBy("source").agg(F.sum("words").alias("source_size")))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("place") % len(values) + 1).cast("int"))
    sources = materialize(sources.withColumn("weight", pick(weights)).withColumn("slope", pick(slopes)))
    level = water_level(sources, share, cap)
    capped = cap * F.col("source_size") < F.lit(level) * F.col("weight")
    sources = sources.withColumn("target", F.when(capped, (cap * F.col("source_size")).cast("double")).otherwise(F.lit(level) * F.col("weight")))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    blocks = materialize(blocks.join(sources, blocks["source"].eqNullSafe(sources["source"])).select(blocks["source"].alias("_source"), F.col("part").alias("_part"), "base", "source_size", "slope", "target"))
    placed = summed.join(blocks, summed["source"].eqNullSafe(blocks["_source"]) & (F.col("part") == F.col("_part")))
    start, size, demand = F.col("base") + F.col("before"), F.col("size"), F.floor(F.col("target") + 0.5)
    words = lambda first: F.greatest(F.lit(0), F.least(demand - first, size))
    firsts = [start + F.col("source_size") * k for k in range(cap)]
    taken = sum((words(first) for first in firsts[1:]), words(firsts[0]))

    def position(first):
        q, a = first / F.col("target"), F.col("slope")
        return F.when(words(first) > 0, F.when(a == 0, q).otherwise((1 + a - F.sqrt((1 + a) * (1 + a) - 4 * a * q)) / F.when(a != 0, 2 * a)))

    positions = F.array_compact(F.array(*[position(x) for x in firsts]))
    return placed.select(*[F.col("row").getField(c).alias(c) for c in kept], "size", "source_size", "target", taken.cast("bigint").alias("taken"), positions.alias("positions"), "order")


def range_sorted(mixed: DataFrame, position: str = "position") -> DataFrame:
    """Rows in training order over range partitions; rows without a position come last, spread by their shuffled order."""
    order = [F.coalesce(F.col(position), F.lit(2.0)), F.col("order")]
    return mixed.repartitionByRange(*order).sortWithinPartitions(*order).drop("order")


def taken_documents(docs: DataFrame) -> DataFrame:
    """A row for each whole time a document is taken (a cut one counts if at least half is), in training order; its columns are
    those of docs, whatever their names."""
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), "doc_id", "source", "text")
    mixed = mix(rows, keep=["row"])
    times = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    copies = mixed.select("row", "order", F.explode(F.slice("positions", F.lit(1), F.least(times, F.size("positions")))).alias("position"))
    return range_sorted(copies).select("row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs, keep=["doc_id"]).withColumn("position", F.try_element_at("positions", F.lit(1)))
    return range_sorted(mixed.select("doc_id", "size", "source_size", "target", "taken", "position", "order"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS ord FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
v AS (SELECT *, [3, 1, 2][(place % 3 + 1)::INT] AS weight, [0.5, -0.5, 0.0][(place % 3 + 1)::INT]::DOUBLE AS slope FROM w),
r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () AS total FROM v),
c AS (SELECT ratio, (1.5::DOUBLE * max(total) - (SELECT coalesce(sum(2 * b.source_size), 0) FROM r b WHERE b.ratio < a.ratio))
             / (SELECT sum(b.weight) FROM r b WHERE b.ratio >= a.ratio) AS level FROM r a GROUP BY ratio),
l AS (SELECT coalesce(arg_min(level, ratio), 0)::DOUBLE AS level FROM c WHERE ratio >= level),
t AS (SELECT source, source_size, slope, CASE WHEN 2 * source_size < level * weight THEN (2 * source_size)::DOUBLE ELSE level * weight END AS target FROM v, l),
p AS (SELECT doc_id, size, source_size, target, slope, floor(target + 0.5)::BIGINT AS demand,
             (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, greatest(0, least(demand - start, size)) AS one, greatest(0, least(demand - start - source_size, size)) AS two, start / target AS q FROM p)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
       CASE WHEN one > 0 THEN CASE WHEN slope = 0 THEN q ELSE (1 + slope - sqrt((1 + slope) * (1 + slope) - 4 * slope * q)) / (2 * slope) END END AS position
FROM k
"""
