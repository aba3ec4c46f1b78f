"""How five document filters overlap: what each removes at each place of each order, and what is lost with it.

A document's failures are a mask of five bits, A to D from native expressions on its whole text, E from the least doc_id
that has the same text. Documents are counted by (part, mask) in at most 32 cells a part; every order of the filters is
then read off the cells, so the texts are read once however many orders there are.

Texts are compared by their SHA-256. Rows of one text are counted by (text, part, labels) with the least doc_id of each
such group before they meet, so many copies of a text make few rows: no copy group is ever in one task.

Nulls: a null text is an empty one, a null lang the part ''; a null doc_id is neither a copy nor an original, and has no
label. Repeated rows are documents of their own; those that share the least doc_id of their text are no copies of each
other. Empty texts are copies of each other. A doc_id with several rows in labels counts as good (toxic) if any of them
says so. An empty table has no parts and gives no rows; further columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import WORD_SPACE, let, read_table

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in permutations(FILTERS))
CELLS = 2 ** len(FILTERS)


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: the text fails A (fewer than 200 words), B (under half of its words are distinct), C (over 3 % capital
    letters), D (a sign of code or tables)."""
    counts = let(F.array_remove(F.split(text, WORD_SPACE), ""), lambda words: F.struct(F.size(words).cast("bigint").alias("n"), F.size(F.array_distinct(words)).cast("bigint").alias("kinds")))
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("bigint")
    fails = let(counts, lambda c: F.when(c["n"] < 200, 1).otherwise(0) + F.when(100 * c["kinds"] < 50 * c["n"], 2).otherwise(0))
    return fails + F.when(100 * capitals > 3 * F.length(text), 4).otherwise(0) + F.when(text.rlike("[#$%&*|]"), 8).otherwise(0)


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang), labels (doc_id, quality, toxic): part, mask (five bits), n, good, toxic, one row a cell that
    holds documents."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text_mask(text).alias("mask"), F.sha2(text.cast("binary"), 256).alias("key"))
    counted = rows.groupBy("doc_id", "key", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("bad"))
    marked = counted.join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "bad")})
    named = F.col("doc_id").isNotNull()
    groups = marked.groupBy("key", "part", "mask", "good", "bad").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(named, 0).otherwise(F.col("n"))).alias("unnamed"),
        F.min(F.when(named, F.struct("doc_id", "n"))).alias("least"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("key"))
    groups = groups.withColumn("passing", F.col("unnamed") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n"))))
    split = groups.select("part", "good", "bad", both.alias("_c")).select("part", "good", "bad", "_c.mask", "_c.n").where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(to) for c, to in (("good", "good"), ("bad", "toxic"))])


def by_order(found: DataFrame) -> DataFrame:
    """Every order and step of each part of cells(): what is kept, removed, redundant, unique, lost; and Shapley's sum."""
    whole = found.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("held"))

    def table(which: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), lambda m: F.coalesce(F.try_element_at("held", m)[which], F.lit(0))).alias(which)

    orders = whole.select("part", table("n"), table("good"), table("toxic"), F.explode(F.split(F.lit(",".join(ORDERS)), ",")).alias("filter_order"))
    bits = F.transform(F.split("filter_order", ""), lambda c: F.call_function("shiftleft", F.lit(1), F.ascii(c) - ord("A")))
    steps = orders.select("*", F.posexplode(bits).alias("at", "bit"), bits.alias("bits"))
    before = F.aggregate(F.slice("bits", F.lit(1), F.col("at")), F.lit(0), lambda acc, b: acc.bitwiseOR(b))
    steps = steps.withColumn("before", before)

    def total(which: str, test) -> Column:
        return F.aggregate(F.filter(which, lambda _, mask: test(mask)), F.lit(0).cast("bigint"), lambda acc, n: acc + n)

    bit, earlier = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    there = lambda m: m.bitwiseAND(earlier) == 0
    out = steps.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"), "bit",
        total("n", lambda m: there(m) & ~fails(m)).alias("kept"),
        total("n", lambda m: there(m) & fails(m)).alias("removed"),
        total("n", lambda m: ~there(m) & fails(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", lambda m: there(m) & fails(m)).alias("good_lost"),
        total("toxic", lambda m: there(m) & fails(m)).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    return by_order(cells(docs, labels))


def op13_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS txt, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
             len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
             100 * length(regexp_replace(txt, '[^A-Z]', '', 'g')) > 3 * length(txt) AS c, regexp_matches(txt, '[#$%&*|]') AS d,
             coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY txt), false) AS e
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
fails AS (SELECT part, good, bad, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
                 || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p, x q, x r, x s, x t
           WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
steps AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, filter_order[1:step - 1] AS earlier FROM orders, generate_series(1, 5) g(step)),
t AS (SELECT part, filter_order, step, own, n, good, bad, failed,
             contains(failed, own) AS hit, len(translate(failed, earlier, '')) < len(failed) AS gone FROM fails, steps),
r AS (SELECT part, filter_order, step, own,
             coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (gone AND hit), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
             coalesce(sum(n) FILTER (NOT gone AND hit AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (NOT gone AND hit AND bad), 0)::BIGINT AS toxic_lost
      FROM t GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
