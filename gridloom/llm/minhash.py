"""Near-duplicate documents: MinHash signatures, banding, exact verification, connected components.

Rows whose sequences of words are equal form one class; only classes are banded and compared. A bucket of a band links
its members to its least member; a class is verified against the one of these that its signature fits best, and the
links give components. Components that other fitting pairs hold together form a zone. In a zone every class outside the
largest component is compared with all others, blocks against blocks, each task returning only the links that join
components. The members of a bucket that fit one of another zone are compared in the same way. So no pair that could
join two components is left out, and neither copies nor near copies ever become rows of all their pairs. A link needs
100 * intersection >= 100 * threshold * union on the distinct shingles of the whole texts: hashed sets propose it, the
shingles' own bytes decide.

Null and empty texts, and texts of white space, have no shingles and link with nothing; a text of fewer words than a
shingle has its whole sequence as its one shingle. A null id is a document without a name: it links, but names no
component. Rows with one id and one text are one document twice: both have the same result. An empty table gives an
empty table. Only doc_id and text are read; without_near_duplicates() keeps all columns as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import joined_words, materialize, mix64, read_table, release, shingle_sets, small_batches, tidy, word_hashes
from gridloom.llm.graph import components

BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Members of a mixed bucket, and shingles of compared sets (a set counts SET_LOAD more), that meet in one task.
BLOCK, SHINGLES, SET_LOAD = 500, 200_000, 100
#: Classes whose signature a task remembers.
REMEMBERED = 1 << 16

_A = mix64(np.arange(101, 101 + HASHES, dtype=np.uint64)) | np.uint64(1)
_B = mix64(np.arange(901, 901 + HASHES, dtype=np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least of each universal hash h(x) = (a x + b mod 2^64) div 2^32."""
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 2048):
        part = np.multiply.outer(shingles[i : i + 2048], _A)
        part += _B
        least = np.minimum(least, (part.min(axis=0) >> np.uint64(32)).astype(np.uint32))
    return least


def _name(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def _summaries(width: int):
    """Each text's class (a digest of its words), number of shingles and, once a task, its class's signature."""

    def run(batches):
        import pyarrow as pa

        seen: set[bytes] = set()
        for batch in small_batches(batches, "text"):
            names, counts, signs = [], [], []
            text, at = joined_words(batch.column("text"))
            for i, shingles in enumerate(shingle_sets(*word_hashes(text, at), width)):
                counts.append(len(shingles))
                if not len(shingles):
                    names.append(None)
                    signs.append(None)
                    continue
                names.append(name := _name(text[at[i] : at[i + 1]]))
                signs.append(None if name in seen else signature(shingles).tobytes())
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(name)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(names, pa.binary()), pa.array(counts, pa.int64()), pa.array(signs, pa.binary())], ["doc_id", "text_hash", "name", "n_shingles", "sign"])

    return run


def _words(batches):
    """The words of each row whose text is that of its class (another text may share the row's id and hash)."""
    import pyarrow as pa

    for batch in small_batches(batches, "text"):
        text, at = joined_words(batch.column("text"))
        words = [text[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        keep = [i for i, (w, name) in enumerate(zip(words, batch.column("name").to_pylist(), strict=True)) if _name(w) == name]
        yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(keep, pa.int64())), pa.array([words[i].tobytes() for i in keep], pa.binary())], ["node", "words"])


def _hashed(words: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted shingle hashes of each of these texts."""
    text = np.frombuffer(b"".join(words), np.uint8)
    return list(shingle_sets(*word_hashes(text, np.cumsum([0, *map(len, words)])), width))


class _Exact:
    """Decides links on the shingles themselves."""

    def __init__(self, width: int, threshold: float) -> None:
        self.width, self.percent = width, round(100 * threshold)
        self.held: dict[int, frozenset[bytes]] = {}

    def shingles(self, node: int, words: bytes) -> frozenset[bytes]:
        if node not in self.held:
            if len(self.held) > 64:
                self.held.clear()
            w = words.split(b" ")
            self.held[node] = frozenset(b" ".join(w[i : i + self.width]) for i in range(max(1, len(w) - self.width + 1)))
        return self.held[node]

    def alike(self, both: int | np.ndarray, a: int, b: int | np.ndarray) -> bool | np.ndarray:
        return 100 * both >= self.percent * (a + b - both)

    def linked(self, a: int, a_words: bytes, b: int, b_words: bytes) -> bool:
        one, other = self.shingles(a, a_words), self.shingles(b, b_words)
        return self.alike(len(one & other), len(one), len(other))


def _signs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(-1, HASHES)


def _agreement(batches):
    """Pairs with the number of equal minima."""
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            same = (_signs(batch.column(2).to_pylist()) == _signs(batch.column(3).to_pylist())).sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.int64())], ["a", "b", "same"])


def least_agreement(threshold: float) -> int:
    """Equal minima below which a pair of that likeness would be 4 standard deviations off."""
    return math.floor(HASHES * threshold - 4 * math.sqrt(HASHES * threshold * (1 - threshold)))


def _active(least: int):
    """Of a block of movers and one of members: those that stand in different zones and whose signatures may fit."""
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        movers, members = group[group.mover], group[~group.mover]
        found = set()
        if len(movers) and len(members):
            signs, nodes, parts = _signs(members.sign), members.node.to_numpy(), members.part.to_numpy()
            for node, part, sign in zip(movers.node, movers.part, movers.sign, strict=True):
                fits = ((signs == np.frombuffer(sign, np.uint32)).sum(axis=1) >= least) & (parts != part)
                if fits.any():
                    found |= {(part, node), *zip(parts[fits], nodes[fits], strict=True)}
        part, node = zip(*sorted(found), strict=True) if found else ((), ())
        return pd.DataFrame({"zone": group.zone.iloc[0], "part": part, "node": node}, columns=["zone", "part", "node"]).astype("int64")

    return run


def _joining(width: int, threshold: float):
    """Of a block of movers and one of members: links that join components, and no more than join them."""
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        movers, members = group[group.mover], group[~group.mover]
        found, root = [], {}

        def top(part: int) -> int:
            while root.get(part, part) != part:
                part = root[part]
            return part

        if len(movers) and len(members):
            exact = _Exact(width, threshold)
            sets = _hashed(list(members.words), width)
            sizes = np.array([len(x) for x in sets])
            universe, place = np.unique(np.concatenate(sets), return_inverse=True)
            first = np.cumsum(sizes) - sizes
            nodes, parts, words = members.node.to_numpy(), members.part.to_numpy(), list(members.words)
            mark = np.zeros(len(universe), np.int32)
            for node, part, spelled, own in zip(movers.node, movers.part, movers.words, _hashed(list(movers.words), width), strict=True):
                at = np.searchsorted(universe, own)
                at = at[(at < len(universe)) & (universe[np.minimum(at, len(universe) - 1)] == own)]
                mark[at] = 1
                both = np.add.reduceat(mark[place], first)
                mark[at] = 0
                for j in np.flatnonzero(exact.alike(both, len(own), sizes) & (parts != part)):
                    p, q = top(part), top(int(parts[j]))
                    if p != q and exact.linked(node, spelled, int(nodes[j]), words[j]):
                        root[max(p, q)] = min(p, q)
                        found.append((node, nodes[j]))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _sets(nodes: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, words): the words of the classes in nodes (node), each once, as a table."""
    wanted = nodes.join(classes, "node").select("node", "name", F.col("first.doc_id").alias("_doc"), F.col("first.text_hash").alias("_hash"))
    found = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["_doc"]) & (texts["text_hash"] == wanted["_hash"])).select("node", "name", "text")
    return materialize(found.mapInArrow(_words, "node long, words binary").groupBy("node").agg(F.first("words").alias("words")))


def _dealt(members: DataFrame, load: Column, most: int) -> DataFrame:
    """members (zone, part, node, ...) as blocks of movers against blocks of all: rows with row, column and mover.

    Movers are those outside a zone's largest part; a zone of one part has none and is left out. However large a zone is,
    what stands under one (zone, row, column) has about twice the load `most`, or is one member; of each pair in different
    parts one is a mover that meets the other.
    """
    sizes = members.groupBy("zone", "part").agg(F.sum(load).alias("_n")).groupBy("zone").agg(F.max_by("part", F.struct("_n", "part")).alias("_pivot"), F.sum("_n").alias("_all"), F.max("_n").alias("_most"), F.count("part").alias("_parts"))
    sized = members.join(sizes.where("_parts > 1"), "zone")
    side = lambda n: F.greatest(F.lit(1), F.ceil(n / most)).cast("int")
    blocks, movers = side(F.col("_all")), side(F.col("_all") - F.col("_most"))
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    places = lambda mover, row, column: F.struct(F.lit(mover).alias("mover"), row.cast("int").alias("row"), column.cast("int").alias("column"))
    stay = F.transform(F.sequence(F.lit(0), movers - 1), lambda k: places(False, k, own(blocks)))
    move = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: places(True, own(movers), k))
    return sized.select(*members.columns, F.explode(F.when(F.col("part") == F.col("_pivot"), stay).otherwise(F.concat(stay, move))).alias("_at")).select(*members.columns, "_at.*")


def _grouped(blocks: DataFrame, *keys: str):
    """Grouped by keys over all shuffle partitions, however few bytes they have: a task's work here is not its bytes."""
    return blocks.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).groupBy(*keys)


def _star(width: int, threshold: float):
    """Links of a star's centre with these of its other classes."""
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        centre, others = group[group.center], group[~group.center]
        found = []
        if len(centre) and len(others):
            exact = _Exact(width, threshold)
            b, b_words = int(centre.node.iloc[0]), centre.words.iloc[0]
            held = _hashed([b_words], width)[0]
            for a, a_words, own in zip(others.node, others.words, _hashed(list(others.words), width), strict=True):
                if exact.alike(len(np.intersect1d(own, held, assume_unique=True)), len(own), len(held)) and exact.linked(a, a_words, b, b_words):
                    found.append((a, b))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _star_links(stars: DataFrame, classes: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets are alike enough, as a table; a centre b with many others has several tasks."""
    sets = _sets(stars.select(F.col("a").alias("node")).union(stars.select(F.col("b").alias("node"))).distinct(), classes, texts)
    sized = stars.join(classes.select(F.col("node").alias("a"), "n_shingles"), "a")
    chunks = sized.groupBy("b").agg(F.ceil(F.sum(F.col("n_shingles") + SET_LOAD) / SHINGLES).cast("int").alias("_chunks"))
    others = stars.join(chunks, "b").select("b", F.pmod(F.xxhash64("a"), F.col("_chunks")).cast("int").alias("chunk"), F.col("a").alias("node"), F.lit(False).alias("center"))
    centres = chunks.select("b", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("chunk"), F.col("b").alias("node"), F.lit(True).alias("center"))
    links = materialize(_grouped(others.union(centres).join(sets, "node"), "b", "chunk").applyInPandas(_star(width, threshold), "a long, b long"))
    release(sets)
    return links


def _zone_links(zones: DataFrame, classes: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links that join the parts of each zone's classes (zone, part, node), as a table."""
    sets = _sets(zones.select("node").distinct(), classes, texts)
    members = zones.join(classes.select("node", "n_shingles"), "node").select("zone", "part", "node", "n_shingles")
    blocks = _dealt(members, F.col("n_shingles") + SET_LOAD, SHINGLES).drop("n_shingles").join(sets, "node")
    links = materialize(_grouped(blocks, "zone", "row", "column").applyInPandas(_joining(width, threshold), "a long, b long").distinct())
    release(sets)
    return links


@tidy
def near_duplicates(docs: DataFrame, width: int = 4, threshold: float = 0.8) -> DataFrame:
    """doc_id, text_hash, part, n_shingles, component_id, kept of every row of docs (doc_id, text); part numbers the group."""
    texts = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    rows = materialize(texts.mapInArrow(_summaries(width), "doc_id long, text_hash long, name binary, n_shingles long, sign binary"))
    named = rows.where("name is not null").groupBy("name").agg(F.first("sign", ignorenulls=True).alias("sign"), F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("n_shingles").alias("n_shingles"))
    classes = materialize(named.withColumn("node", F.monotonically_increasing_id()))

    width_bytes = 4 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.col("sign").substr(i * width_bytes + 1, F.lit(width_bytes))))
    bands = classes.select("node", F.explode(keys).alias("band"))
    shared = bands.groupBy("band").agg(F.min("node").alias("center"), F.count("node").alias("_n")).where("_n > 1").drop("_n")
    buckets = materialize(bands.join(shared, "band"))

    least = least_agreement(threshold)
    signs = classes.select("node", "sign")
    stars = buckets.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    fits = stars.join(signs.toDF("a", "sa"), "a").join(signs.toDF("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(_agreement, "a long, b long, same long").where(F.col("same") >= least)
    fits = materialize(fits)
    best = fits.groupBy("a").agg(F.max_by("b", F.struct("same", "b")).alias("b"))
    links = _star_links(materialize(best), classes, texts, width, threshold)
    parts = materialize(components(links))

    of = lambda name: parts.select(F.col("node").alias(name), F.col("component").alias(f"_{name}"))
    ties = fits.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")).where("a <> b").distinct()
    zone, more = parts.withColumnRenamed("component", "zone"), []
    if not (ties := materialize(ties)).isEmpty():
        held = components(ties).select(F.col("node").alias("part"), F.col("component").alias("zone"))
        zones = materialize(held.join(parts, F.col("part") == F.col("component"), "left").select("zone", "part", F.coalesce("node", "part").alias("node")))
        more.append(_zone_links(zones, classes, texts, width, threshold))
        inside = zones.select("node", "zone")
        zone = zone.join(inside.select("node"), "node", "left_anti").union(inside)
    release(fits)

    # classes of one zone have met; a bucket's members of different zones meet here
    members = materialize(buckets.join(zone, "node", "left").select(F.col("band").alias("zone"), "node", F.coalesce("zone", "node").alias("part")))
    release(buckets)
    active = _grouped(_dealt(members, F.lit(1), BLOCK).join(signs, "node"), "zone", "row", "column").applyInPandas(_active(least), "zone long, part long, node long").distinct()
    if not (active := materialize(active)).isEmpty():
        more.append(_zone_links(active, classes, texts, width, threshold))
    if more:
        parts = materialize(components(reduce(DataFrame.union, more, links)))

    ids = classes.join(parts, "node", "left").select("name", "least_id", F.coalesce("component", "node").alias("_part"))
    joined = ids.join(parts.select(F.col("component").alias("_part")).distinct(), "_part").groupBy("_part").agg(F.min("least_id").alias("_id"))
    ids = ids.join(joined, "_part", "left").select("name", F.coalesce("_id", "least_id").alias("component_id"), F.col("_part").alias("part"))
    done = rows.join(ids, "name", "left").withColumn("component_id", F.when(F.col("part").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return done.select("doc_id", "text_hash", "part", "n_shingles", "component_id", kept.alias("kept"))


@tidy
def without_near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each group of near copies: the one with the least id, once even where its row is repeated; of a group
    without ids any one. Columns of docs are kept as they are."""
    found = materialize(near_duplicates(docs.select("doc_id", "text"), width, threshold))
    keys = ["doc", "hash"]
    named = lambda df, *more: df.select(F.col("doc_id").alias("doc"), F.col("text_hash").alias("hash"), *more)
    left = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.col("doc_id").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))

    def same(other: DataFrame) -> Column:
        return left["doc"].eqNullSafe(other["doc"]) & (left["hash"] == other["hash"])

    gone = named(found.where("not kept")).distinct()
    left = left.join(gone, same(gone), "left_anti")
    kept = found.where("kept and part is not null")
    again = kept.groupBy("part").count().where("count > 1").select("part")
    if not again.isEmpty():  # repeated rows, or groups without any id
        marked = named(kept.join(again, "part"), "part").distinct()
        ones = left.join(marked, same(marked)).select("row", left["doc"], left["hash"], "part").groupBy("part").agg(F.first("row").alias("row"))
        left = left.join(marked.select(*keys), same(marked), "left_anti").select("row").unionAll(ones.select("row"))
    return left.select("row.*")


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


#: The same components by joining all shingles, in DuckDB's SQL; for unique ids.
OP6_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS sh FROM d),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p WHERE 100 * c >= 80 * (na + nb - c)),
r(doc_id, component) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.component FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(component) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON s.doc_id = m.doc_id
"""
