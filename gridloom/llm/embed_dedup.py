"""Near-duplicate vectors by an inverted multi-index.

The two halves of every unit vector are coded by codebooks of their own (k-means on a bounded sample), and the pair of
codes is a cell of the product grid. A vector visits cells by multi-sequence traversal: of the two sequences of codes,
each in ascending order of the least squared distance that a vector there can have, the pair with the least sum is taken
next. Target recall is 1, so the traversal ends where that sum exceeds what the threshold allows: all vectors that it must
be linked with have been reached, and each is verified by its cosine in doubles.

Vectors are compared within a label (and length). Equal vectors form one class with a weight, so copies never meet in
pairs. Every label, however small, is searched through the grid, and only members of visited cells are verified. The codes a
half grow with the largest label of a vector length, as the square root of its classes over CELL, so a cell holds about CELL
classes (up to CODES codes; beyond that cells grow, results stay). Cells near each other share a tile, which is what is
shuffled: a vector is sent once to each tile in which it visits a cell from its own on, with the list of those cells. A
tile's members are dealt into parts of about BLOCK, its visitors into chunks of about BLOCK, and a task holds one part and
one chunk, however large a label is or however little structure its vectors have. It returns counts and a spanning forest
of its links, not the pairs.

Vectors that are null, empty, zero or hold null or non-finite parts, or without a label, link with nothing and stand
alone; so do vectors of different lengths with each other. Labels may be of any type that groups. A null vec_id is a vector without a name. Rows that repeat a
vec_id are vectors of their own. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, read_table, release, tidy
from gridloom.llm.graph import components

CELL, CODES, SAMPLE, ROUNDS, BLOCK = 8, 1024, 8192, 12, 2000
#: Sampled vectors a code, where that is more than SAMPLE; and cells of all rows that are traversed at once.
PER_CODE, AT_ONCE = 32, 1 << 24


def codebook(x: np.ndarray, codes: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """k-means centres; fewer where there are fewer different rows."""
    if not x.shape[1]:
        return np.zeros((1, 0))
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    centres = x[rng.permutation(len(x))[:codes]]
    for _ in range(rounds):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def _bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's own code, and the squared least distance from it to any vector of each code."""
    square = np.column_stack([((x - c) ** 2).sum(1) for c in centres])
    own = square.argmin(1)
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))[own]
    gap = (square - square[np.arange(len(x)), own][:, None]) / np.where(apart > 0, 2 * apart, 1)
    return own, np.maximum(gap, 0) ** 2


def traversal(a: np.ndarray, b: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first code and second code of every cell within reach, each row's in ascending order of the sum of both bounds.

    Every row keeps, for each place of its first sequence, the place of the second one that comes next to it; a step takes
    the least sum of each row and moves that place on, and a row whose least sum is out of reach has ended.
    """
    order_a, order_b = a.argsort(1), b.argsort(1)
    sorted_a, sorted_b = np.take_along_axis(a, order_a, 1), np.take_along_axis(b, order_b, 1)
    sorted_b = np.column_stack([sorted_b, np.full(len(b), np.inf)])
    following = np.zeros(a.shape, np.int64)
    live = np.arange(len(a))
    rows, first, second = [], [], []
    while len(live):
        sums = sorted_a[live] + np.take_along_axis(sorted_b[live], following[live], 1)
        i = sums.argmin(1)
        near = sums[np.arange(len(live)), i] <= reach
        live, i = live[near], i[near]
        j = following[live, i]
        rows.append(live)
        first.append(order_a[live, i])
        second.append(order_b[live, j])
        following[live, i] += 1
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, first, second))


class Grid:
    """Both codebooks, and the cells' ranks along a curve that keeps near ones together."""

    def __init__(self, sample: np.ndarray, codes: int) -> None:
        self.half = -(-sample.shape[1] // 2)
        self.books = [codebook(sample[:, : self.half], codes), codebook(sample[:, self.half :], codes)]
        spread = []
        for book in self.books:
            along = book @ np.linalg.svd(book - book.mean(0), full_matrices=False)[2][0] if len(book) > 1 else np.zeros(1)
            spread.append(along.argsort().argsort())
        bits = range(max(map(len, self.books)).bit_length())
        curve = sum(((spread[0][:, None] >> k & 1) << 2 * k + 1) + ((spread[1][None] >> k & 1) << 2 * k) for k in bits)
        self.rank = curve.ravel().argsort().argsort()

    def tile(self, cell: np.ndarray, tiles: np.ndarray) -> np.ndarray:
        return cell * np.minimum(tiles, len(self.rank)) // len(self.rank)

    def bounds(self, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        return [_bounds(x[:, : self.half], self.books[0]), _bounds(x[:, self.half :], self.books[1])]

    def own(self, x: np.ndarray) -> np.ndarray:
        """Each row's cell, by its rank."""
        (a, _), (b, _) = self.bounds(x)
        return self.rank[a * len(self.books[1]) + b]

    def visits(self, x: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the ranks of the cells that they visit."""
        (_, a), (_, b) = self.bounds(x)
        row, first, second = traversal(a, b, reach)
        return row, self.rank[first * len(self.books[1]) + second]


def _units(column) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _slices(batches, grids: dict[int, Grid]):
    """Small batches of vectors of one length, with the grid of that length."""
    import pyarrow as pa

    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims):
            rows, grid = np.flatnonzero(dims == dim), grids[int(dim)]
            step = int(np.clip(AT_ONCE // len(grid.rank), 16, 2048))
            for at in range(0, len(rows), step):
                yield batch.take(pa.array(rows[at : at + step])), grid


def _coded(grids: dict[int, Grid]):
    """Every class with its own cell and that cell's tile."""

    def run(batches):
        import pyarrow as pa

        for part, grid in _slices(batches, grids):
            own = grid.own(_units(part.column("embedding")))
            tile = grid.tile(own, part.column("tiles").to_numpy())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own), pa.array(tile)], [*part.schema.names, "own", "tile"])

    return run


def _visits(grids: dict[int, Grid], reach: float):
    """Every class with each tile in which it visits cells from its own on, and those cells."""

    def run(batches):
        import pyarrow as pa

        for part, grid in _slices(batches, grids):
            own, tiles = part.column("own").to_numpy(), part.column("tiles").to_numpy()
            row, cell = grid.visits(_units(part.column("embedding")), reach)
            row, cell = row[ahead := cell >= own[row]], cell[ahead]
            tile = grid.tile(cell, tiles[row])
            order = np.lexsort((cell, row))  # tiles ascend with cells
            row, cell, tile = row[order], cell[order], tile[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (tile[1:] != tile[:-1])])
            cells = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.array(cell))
            taken = part.drop_columns(["tile"]).take(pa.array(row[first]))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(tile[first]), cells], [*taken.schema.names, "tile", "cells"])

    return run


def _forest(linked: np.ndarray, queries: np.ndarray, members: np.ndarray) -> list[tuple[int, int]]:
    """Edges that join exactly what the link matrix joins."""
    q, m = queries.copy(), members.copy()
    top = np.iinfo(np.int64).max
    while True:
        up = np.minimum(q, np.where(linked, m[None], top).min(1, initial=top))
        down = np.minimum(m, np.where(linked, up[:, None], top).min(0, initial=top))
        if (up == q).all() and (down == m).all():
            break
        q, m = up, down
    return [(int(n), int(r)) for nodes, roots in ((queries, q), (members, m)) for n, r in zip(nodes, roots, strict=True) if n != r]


def _normed(vectors) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _meetings(own: np.ndarray, cells):
    """Members and visitors of every cell that has both, at most 512 visitors at a time."""
    by_cell = own.argsort(kind="stable")
    asked = np.concatenate(cells.to_numpy())
    asking = np.repeat(np.arange(len(cells)), cells.str.len())
    order = asked.argsort(kind="stable")
    asked, asking = asked[order], asking[order]
    for cell in np.intersect1d(own, asked):
        members = by_cell[slice(*np.searchsorted(own[by_cell], [cell, cell + 1]))]
        start, end = np.searchsorted(asked, [cell, cell + 1])
        for at in range(start, end, 512):
            yield cell, members, asking[at : min(at + 512, end)]


def _compared(threshold: float):
    import pandas as pd

    def run(members: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        edges, links, back = [], np.zeros(len(queries), np.int64), np.zeros(len(members), np.int64)
        if len(members) and len(queries):
            nodes, weight, x = members.node.to_numpy(), members.copies.to_numpy(), _normed(members.embedding)
            asked, times, own, y = queries.node.to_numpy(), queries.copies.to_numpy(), queries.own.to_numpy(), _normed(queries.embedding)
            for cell, m, q in _meetings(members.own.to_numpy(), queries.cells):
                linked = (y[q] @ x[m].T >= threshold) & (asked[q][:, None] != nodes[m][None])
                if linked.any():
                    links[q] += linked @ weight[m]
                    back[m] += (times[q] * (own[q] < cell)) @ linked  # the members do not visit these queries' cells
                    edges += _forest(linked, asked[q], nodes[m])
        found = [(int(n), None, int(c)) for ids, sums in ((queries.node, links), (members.node, back)) for n, c in zip(ids, sums, strict=True) if c]
        found += [(a, b, 0) for a, b in edges]
        a, b, n = zip(*found, strict=True) if found else ((), (), ())
        return pd.DataFrame({"a": pd.array(a, "int64"), "b": pd.array(b, "Int64"), "links": pd.array(n, "int64")})

    return run


def _grids(classes: DataFrame, sizes: DataFrame) -> dict[int, Grid]:
    """The grid of each vector length: codes by its largest label, learned from at most SAMPLE vectors or PER_CODE a code."""
    grids = {}
    for dim, most in sizes.groupBy("dim").agg(F.max("n")).orderBy("dim").collect():
        codes = min(max(2, math.ceil(math.sqrt(most / CELL))), CODES)
        luck = classes.where(F.col("dim") == dim).select("embedding", F.xxhash64("node").alias("_luck")).orderBy("_luck")
        sample = luck.limit(max(SAMPLE, PER_CODE * codes)).select("embedding").toArrow()
        grids[dim] = Grid(_units(sample.column("embedding").combine_chunks()), codes)
    return grids


def _linked(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, null, links) counts and (a, b, 0) edges of the classes, as a table."""
    sizes = materialize(classes.groupBy("label", "dim").agg(F.count("node").alias("n")).withColumn("tiles", F.ceil(F.col("n") / BLOCK)))
    grids = _grids(classes, sizes)
    held = f"node long, label {dict(classes.dtypes)['label']}, dim int, copies long, embedding array<float>, tiles long, own long"
    tiled = classes.join(sizes, ["label", "dim"]).select("node", "label", "dim", "copies", "embedding", "tiles")
    members = materialize(tiled.mapInArrow(_coded(grids), f"{held}, tile long"))
    tile = ["label", "dim", "tile"]
    parts = members.groupBy(*tile).agg(F.ceil(F.count("node") / BLOCK).alias("parts"))
    visits = members.mapInArrow(_visits(grids, 2 - 2 * threshold + 1e-9), f"{held}, tile long, cells array<long>").drop("tiles")
    visits = materialize(visits.join(parts, tile).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts"))
    block = [*tile, "part"]
    chunks = visits.groupBy(*block).agg(F.ceil(F.count("node") / BLOCK).alias("chunks"))
    placed = members.join(parts, tile).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    placed = placed.join(chunks, block).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    asking = visits.join(chunks, block).withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")))
    keys = [*block, "chunk"]
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a task's work here is not its bytes
    left = placed.select(*keys, "own", "node", "copies", "embedding").repartition(n, *keys).groupBy(*keys)
    right = asking.select(*keys, "own", "cells", "node", "copies", "embedding").repartition(n, *keys).groupBy(*keys)
    found = materialize(left.cogroup(right).applyInPandas(_compared(threshold), "a long, b long, links long"))
    release(visits, members, sizes)
    return found


@tidy
def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors (vec_id, embedding, label)."""
    parts = F.transform("embedding", lambda x: x.cast("double"))
    sound = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x * x)
    valid = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & sound & (square > 0) & (square < float("inf")), F.lit(False))
    rows = vectors.select("vec_id", "label", F.when(valid, F.col("embedding")).alias("embedding"))
    named = rows.where("embedding is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("least_id"), F.count("label").alias("copies"))
    classes = materialize(named.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("embedding")))
    found = _linked(classes, threshold)
    joined = components(found.where("b is not null").select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    ids = materialize(classes.join(joined, "node", "left").join(counts, F.col("node") == F.col("a"), "left").select("label", "embedding", "least_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("_part")))
    least = ids.groupBy("_part").agg(F.min("least_id").alias("component_id"))
    ids = ids.join(least, "_part").select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), "n_links", "component_id")
    done = rows.join(ids, (F.col("label") == F.col("_label")) & (F.xxhash64("embedding") == F.xxhash64("_embedding")) & (F.col("embedding") == F.col("_embedding")), "left")
    component = F.when(F.col("_label").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return done.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


#: The same by comparing all pairs of a label, in DuckDB's SQL; for unique ids and sound vectors of one length.
OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r(vec_id, component) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.b, r.component FROM r JOIN e ON e.a = r.vec_id),
m AS (SELECT vec_id, min(component) AS component_id FROM r GROUP BY vec_id), n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT m.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n ON n.a = m.vec_id
"""
