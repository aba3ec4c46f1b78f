"""Prefix trie of conversations: what they share, turn by turn, and what sharing it saves.

A node is a distinct sequence of first turns; each is owned by its smallest member. The members of a node's subtree are
among its own, so a conversation owns a suffix of its path. Windows mark the owned nodes: first the smallest of each of
several parts of a node's members, then the smallest of these, so that no window holds all members of a hot node. One
group-by over all (conversation, depth) pairs then gives every node its numbers: a member adds the words of its turns below
the node that it does not own (occurrences minus owned), and 1 if it owns a leaf.

Turns are range-sorted once by (conv_id, turn, role, text), a part of a conversation in a task; depths and running sums are
those inside the part plus the sums of the conversation's earlier parts. A sequence is known by its depth and the sum of
128-bit hashes (SHA-256) of (place, turn), so a long conversation needs no fold from its start. Joins on a node or a conversation
send apart those that hold over 1/1024 of all pairs, of which there are at most 1024: these, and only these, are broadcast.

ends_sha256 streams over ids in order: blocks of 1024 consecutive ids are joined first, a task then hashes a node's blocks.

Nulls: a null turn comes first, a null role or text is empty; rows with a null conv_id belong to no conversation and are left
out. Ties of turn are ordered by role, then text, by code point; repeated rows are turns of their own. Texts count whole.
An empty table has no conversation and so no node, not even a root. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import WORD, materialize, read_table, tidy

#: A base conversation lends its first turns to the ones up to the next multiple.
EVERY, LENT = 20, 4
SUMS = ("s0", "s1", "s2", "s3")
NODE = ["depth", *SUMS]
UP = [f"up_{c}" for c in NODE]
HOT = 1024
BLOCK = 10
_NONE = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, part, at (order inside the part), place (from 1 in the conversation), tokens, digest; text itself is left behind."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    read = conversations.where("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    by = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "row"]
    ordered = read.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    small = materialize(ordered.select("conv_id", F.shiftright("at", 33).alias("part"), "at", F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("tokens"), digest.alias("digest")))
    return running(small, {"place": F.lit(1)})


def running(rows: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """rows (conv_id, part, at) with running sums in that order, the row itself included; no window is longer than a part."""
    inside = Window.partitionBy("conv_id", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    base = totals.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    local = rows.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    joined = local.join(base, (F.col("conv_id") == F.col("_c")) & (F.col("part") == F.col("_p")))
    return joined.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_c", "_p", *[f"_{n}" for n in sums])


def as_they_are(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A rebuilding of turns() that leaves them as they are: rows with depth and the number of turns, and that number a conv_id."""
    lengths = found.groupBy("conv_id").agg(F.count("*").alias("turns"))
    rows = joined_apart(found.withColumnRenamed("place", "depth"), lengths, ["conv_id"], lengths.select("conv_id", F.col("turns").alias("_rows")))
    return rows, lengths


def sharing(every: int = EVERY, lent: int = LENT) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """A rebuilding of turns(): a conversation c begins with the first crc32(c) % lent turns of c - c % every, in place of its own."""

    def rebuild(found: DataFrame) -> tuple[DataFrame, DataFrame]:
        of = lambda place: F.when(F.col("place") == place, F.struct("tokens", "digest"))  # noqa: E731
        convs = materialize(found.groupBy("conv_id").agg(F.count("*").alias("own"), F.array_compact(F.array(*[F.max(of(k)) for k in range(1, lent)])).alias("first")))
        head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % lent).cast("int")
        bases = convs.select(F.col("conv_id").alias("base"), "first")
        taken = F.slice(F.coalesce("first", F.array().cast("array<struct<tokens:bigint,digest:string>>")), F.lit(1), head)
        plan = convs.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % every).alias("base")).join(bases, "base", "left").select("conv_id", "own", head.alias("h"), taken.alias("taken"))
        plan = materialize(plan.withColumn("turns", F.size("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))))
        lengths = plan.select("conv_id", "turns")
        begun = plan.select("conv_id", "turns", F.posexplode("taken").alias("_k", "_t")).select("conv_id", F.lit(-1).cast("bigint").alias("part"), F.col("_k").cast("bigint").alias("at"), "_t.tokens", "_t.digest", (F.col("_k") + 1).cast("bigint").alias("depth"), "turns")
        shift = plan.select("conv_id", "h", (F.size("taken") - F.col("h")).alias("_by"), "turns")
        own = joined_apart(found, shift, ["conv_id"], plan.select("conv_id", F.col("own").alias("_rows"))).where("place > h")
        return begun.unionByName(own.select("conv_id", "part", "at", "tokens", "digest", (F.col("place") + F.col("_by")).alias("depth"), "turns")), lengths

    return rebuild


def joined_apart(rows: DataFrame, table: DataFrame, on: list[str], weights: DataFrame) -> DataFrame:
    """rows with the columns of table (unique in `on`, all keys of rows), keys of over 1/HOT of all weight by broadcast.

    weights (on, _rows): rows of each key; at most HOT keys can have so many, so what is broadcast is bounded.
    """
    total = weights.agg(F.sum("_rows")).first()[0] or 0
    hot = materialize(weights.where(F.col("_rows") * HOT > total).select(*on))
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    many = marked.where("_hot").drop("_hot").join(F.broadcast(table.join(F.broadcast(hot), on, "left_semi")), on)
    few = marked.where("_hot is null").drop("_hot").join(table, on)
    return many.unionByName(few)


def paths(rebuilt: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row a conversation and depth, from 0 on: conv_id, turns, node, parent node, and the tokens before (start) and with it (upto)."""
    digest = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest").cast("binary"), 256)
    # 4 x 32 bits, so that sums of up to 2^31 turns fit a long
    limbs = {f"h{s}": F.conv(F.substring("_d", 8 * k + 1, 8), 16, 10).cast("bigint") for k, s in enumerate(SUMS)}
    hashed = rebuilt.withColumn("_d", digest).select("conv_id", "turns", "part", "at", "depth", "tokens", *[c.alias(n) for n, c in limbs.items()])
    summed = running(hashed, {"upto": F.col("tokens")} | {s: F.col(f"h{s}") for s in SUMS})
    below = summed.select("conv_id", "turns", *NODE, (F.col("depth") - 1).alias("up_depth"), *[(F.col(s) - F.col(f"h{s}")).alias(f"up_{s}") for s in SUMS], (F.col("upto") - F.col("tokens")).alias("start"), "upto")
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    root = lengths.select("conv_id", "turns", *[zero.alias(c) for c in NODE], *[none.alias(c) for c in UP], zero.alias("start"), zero.alias("upto"))
    return root.unionByName(below)


def owned(pairs: DataFrame, parts: int) -> DataFrame:
    """The rows of pairs that their node's smallest member owns, with leaf (no member goes on)."""
    part = F.pmod(F.xxhash64("conv_id"), F.lit(parts)).alias("_part")
    some = Window.partitionBy(*NODE, "_part")
    everyone = Window.partitionBy(*NODE)
    first = pairs.select("*", part, (F.col("turns") > F.col("depth")).alias("_more"))
    first = first.withColumns({"_k": F.row_number().over(some.orderBy("conv_id")), "_more": F.max("_more").over(some)}).where("_k = 1")
    first = first.withColumns({"_k": F.row_number().over(everyone.orderBy("conv_id")), "_more": F.max("_more").over(everyone)}).where("_k = 1")
    return first.withColumn("leaf", ~F.col("_more")).drop("_k", "_more", "_part")


def end_hashes(pairs: DataFrame) -> DataFrame:
    """node, ends_sha256 of the conversations that end there."""
    blocks = pairs.where("depth = turns").groupBy(*NODE, F.shiftright("conv_id", BLOCK).alias("block")).agg(F.array_join(F.transform(F.sort_array(F.collect_set("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    ordered = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block")

    def run(batches):
        import pyarrow as pa

        node, state, done = None, None, []

        def made():
            columns = list(zip(*done, strict=True)) or [()] * (len(NODE) + 1)
            done.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], [*NODE, "ends_sha256"])

        for batch in batches:
            for *here, ids in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in [*NODE, "ids"]), strict=True):
                if here == node:
                    state.update(b",")
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = here, hashlib.sha256()
                state.update(ids.encode())
            yield made()
        if node:
            done.append((*node, state.hexdigest()))
            yield made()

    return ordered.mapInArrow(run, ", ".join(f"{c} bigint" for c in NODE) + ", ends_sha256 string")


@tidy
def trie(conversations: DataFrame, rebuild: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = as_they_are) -> DataFrame:
    """A row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rebuilt, lengths = rebuild(materialize(turns(conversations)))
    pairs = materialize(paths(rebuilt, lengths))
    marks = materialize(owned(pairs, parts).select("conv_id", "depth", "start", "leaf"))
    # of each conversation: where its owned suffix begins, the tokens before that (all, if it owns nothing), and its leaf
    seen = pairs.select("conv_id", "turns", "upto", F.lit(None).cast("struct<depth:bigint,start:bigint>").alias("own"), F.lit(0).alias("leaf"))
    seen = seen.unionByName(marks.select("conv_id", F.lit(None).cast("bigint").alias("turns"), F.lit(None).cast("bigint").alias("upto"), F.struct("depth", "start").alias("own"), F.col("leaf").cast("int").alias("leaf")))
    convs = seen.groupBy("conv_id").agg(F.max("turns").alias("turns"), F.max("upto").alias("all"), F.min("own").alias("own"), F.max("leaf").alias("leaf"))
    convs = materialize(convs.select("conv_id", F.col("turns").alias("_turns"), F.coalesce("own.depth", F.col("turns") + 1).alias("_from"), F.coalesce("own.start", "all").alias("_before"), F.col("leaf").alias("_leaf")))
    members = joined_apart(pairs, convs, ["conv_id"], convs.select("conv_id", (F.col("_turns") + 1).alias("_rows")))
    child = (F.col("_from") <= F.col("depth") + 1) & (F.col("depth") < F.col("_turns"))
    nodes = materialize(
        members.groupBy(*NODE).agg(
            F.min("conv_id").alias("conv_id"),
            *[F.min(c).alias(c) for c in UP],
            F.count("*").alias("n_convs"),
            F.sum(child.cast("bigint")).alias("n_children"),
            F.sum(F.col("_leaf").cast("bigint")).alias("n_leaves"),
            F.sum(F.greatest(F.lit(0), F.col("_before") - F.col("start"))).cast("bigint").alias("saved_tokens"),
        )
    )
    parents = nodes.where("n_children > 0").select(*[F.col(c).alias(u) for c, u in zip(NODE, UP, strict=True)], F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_rows"))
    linked = joined_apart(nodes.where("depth > 0"), parents.drop("_rows"), UP, parents.select(*UP, "_rows"))
    linked = linked.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast(nodes.schema["conv_id"].dataType)))
    out = linked.join(end_hashes(pairs), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NONE)))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(read_table(spark, sf_dir, "conversations"), sharing())


OP11_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, txt) AS place,
             sha256(length(role)::VARCHAR || ':' || role || txt) AS item, len(regexp_extract_all(txt, '[^ 	-]+'))::BIGINT AS words FROM c),
ids AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 20 AS base,
               xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                   lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 4 AS h FROM o GROUP BY conv_id),
r AS (SELECT i.conv_id, o.place AS depth, item, words FROM ids i JOIN o ON o.conv_id = i.base AND o.place <= i.h
      UNION ALL
      SELECT i.conv_id, o.place - i.h + least(i.h, coalesce(b.own, 0)), item, words FROM ids i JOIN o ON o.conv_id = i.conv_id AND o.place > i.h LEFT JOIN ids b ON b.conv_id = i.base),
p AS (SELECT conv_id, depth, words, string_agg(item, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path, max(depth) OVER (PARTITION BY conv_id) AS last FROM r
      UNION ALL SELECT conv_id, 0, 0, '', coalesce((SELECT max(depth) FROM r WHERE r.conv_id = ids.conv_id), 0) FROM ids),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256 FROM p GROUP BY path, depth),
k AS (SELECT n.path, count(m.path) AS n_children FROM n LEFT JOIN n m ON m.depth = n.depth + 1 AND left(m.path, 64 * n.depth) = n.path GROUP BY n.path),
s AS (SELECT left(n.path, 64 * d) AS path, sum((k.n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * words)::BIGINT AS saved_tokens
      FROM n JOIN k ON k.path = n.path, generate_series(0, n.depth) g(d) GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, k.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN k ON k.path = n.path JOIN s ON s.path = n.path LEFT JOIN n u ON u.depth = n.depth - 1 AND u.path = left(n.path, 64 * (n.depth - 1))
"""
