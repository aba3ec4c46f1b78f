"""Watershed by a minimum spanning forest: flooding from markers without a queue and without a volume in a task.

Heights are ordered by (v, i), so no two voxels of a volume are level, and the labels are those of a flood that always takes up
the least voxel next to what is flooded. An edge of face neighbours is as high as its higher voxel.

First the levels: the lowest height at which water reaches each voxel. In rounds of Boruvka's, every part without a marker picks
its lowest edge out, its lip; the parts so joined are found by star contraction and edges within them go. A voxel's level is the
highest lip that its parts picked before they met a marker: no lip picked later on the way to it is higher than the one before.
Parts at least halve each round. Then the labels: water that rises above a voxel came over the lip that gives its level, and a
voxel that is its own lip took it from the neighbour that was flooded first. These pointers form trees with a marker as root, which
star contraction finds too. All state is in tables; steps are grouped minima and equi-joins.

Where all volumes are small, each is flooded in one task by a queue in the same order, some volumes a group.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.dense import AXES, Cells, by_volumes, stack_bits
from gridloom.operators.graph import components
from gridloom.shared import materialize, release, tidy

PLACE = ["t", "x", "y", "z"]


def _pairs(nodes: DataFrame, held: list[str]) -> DataFrame:
    """Face neighbours (a, b) with the columns in held of both ends, each pair once."""
    steps = F.array(*[F.struct(*[(F.col(c) + int(c == axis)).alias(c) for c in "xyz"]) for axis in "xyz"])
    near = nodes.select("t", F.explode(steps).alias("_to"), F.col("node").alias("a"), *[F.col(c).alias(f"{c}_a") for c in held])
    near = near.select("t", "_to.x", "_to.y", "_to.z", "a", *[f"{c}_a" for c in held])
    return near.join(nodes.select(*PLACE, F.col("node").alias("b"), *[F.col(c).alias(f"{c}_b") for c in held]), PLACE).drop(*PLACE)


def _joined(parts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, lip, into, dry) of every part without a marker that has an edge out, and the edges between the parts made so."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "lip"))
    dry = parts.where("dry").select(F.col("part").alias("a"))
    picks = materialize(both.join(dry, "a", "left_semi").groupBy("a").agg(F.min(F.struct("lip", "b")).alias("_p")).select("a", F.col("_p.b").alias("b"), F.col("_p.lip").alias("lip")))
    found = materialize(components(picks.select("a", "b")))
    wet = found.join(parts.where("not dry").select(F.col("part").alias("node")), "node", "left_semi").select("component").distinct().withColumn("_wet", F.lit(True))
    merged = materialize(
        parts.join(found.withColumnRenamed("node", "part"), "part", "left")
        .join(wet, "component", "left")
        .join(picks.select(F.col("a").alias("part"), "lip"), "part", "left")
        .select("part", "lip", F.coalesce("component", "part").alias("into"), (F.col("dry") & F.col("_wet").isNull()).alias("dry"))
    )
    ends = [merged.select(F.col("part").alias(c), F.col("into").alias(f"_{c}"), F.col("dry").alias(f"_dry_{c}")) for c in "ab"]
    moved = edges.join(ends[0], "a").join(ends[1], "b").where("_a <> _b and (_dry_a or _dry_b)")
    least = moved.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min("lip").alias("lip"))
    out = materialize(least)
    release(picks, found)
    return merged, out


@tidy
def levels(nodes: DataFrame) -> DataFrame:
    """nodes (t, x, y, z, node, height, marker) with level: the height at which each is flooded; null where no marker reaches."""
    edges = materialize(_pairs(nodes, ["height"]).select("a", "b", F.greatest("height_a", "height_b").alias("lip")))
    held = materialize(nodes.select("node", F.col("node").alias("part"), F.col("height").alias("level"), F.col("marker").isNull().alias("dry")))
    parts = held.select("part", "dry")
    while not edges.isEmpty():
        merged, after = _joined(parts, edges)
        risen = materialize(
            held.join(merged.withColumnRenamed("dry", "_dry"), "part", "left")
            .select("node", F.coalesce("into", "part").alias("part"), F.greatest("level", "lip").alias("level"), F.coalesce("_dry", "dry").alias("dry"))
        )
        next_parts = materialize(merged.groupBy(F.col("into").alias("part")).agg(F.min("dry").alias("dry")))
        release(held, edges, merged)
        held, edges, parts = risen, after, next_parts
    return nodes.join(held.select("node", F.when(~F.col("dry"), F.col("level")).alias("level")), "node")


def _flooded(c: Cells) -> dict:
    """Labels and levels of a group of whole volumes: the least voxel next to what is flooded comes next."""
    import pyarrow as pa

    # one order of heights over the group, in which volumes do not meet; NaN last
    order = np.lexsort((c["i"], c["v"]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    cells = c.box(rank, -1).tolist()
    at = c.at[order].tolist()
    marker = np.where(c.null("marker"), 0, c["marker"]).astype(np.int64)[order]
    label, level = marker.tolist(), [-1] * len(order)
    steps = [s * c.step(*d) for d in ((1, 0, 0), (0, 1, 0), (0, 0, 1)) for s in (1, -1)]
    heap = [(k, k) for k in np.flatnonzero(marker).tolist()]
    while heap:
        high, k = heapq.heappop(heap)
        level[k] = high
        for step in steps:
            near = cells[at[k] + step]
            if near >= 0 and not label[near]:
                label[near] = label[k]
                heapq.heappush(heap, (max(high, near), near))
    level = np.array(level)
    found = {"label": np.array(label)[rank], "level": pa.array(c["v"][order][np.maximum(level, 0)][rank], mask=(level < 0)[rank])}
    return {k: c.table.column(k) for k in ("t", "i", *AXES)} | found


@tidy
def watershed(voxels: DataFrame, stacked: bool = True) -> DataFrame:
    """voxels (t, x, y, z, i, v, marker): (t, i, x, y, z, label, level): the marker (above 0) whose water reaches each voxel first,
    and the height at which it does.

    Markers keep their own label. A null or NaN height is flooded last; a null marker is none. Volumes (or parts of volumes, where
    voxels are missing) without markers have label 0 and no level. (t, x, y, z) and (t, i) are unique. Other columns are not read.
    stacked: small volumes go to a task whole, some together; the result is the same.
    """
    v = F.coalesce(F.col("v").cast("double"), F.lit(float("nan")))
    named = voxels.select(*PLACE, "i", v.alias("v"), F.when(F.col("marker") > 0, F.col("marker").cast("bigint")).alias("marker"))
    bits = stack_bits(named) if stacked else None
    if bits is not None:
        kind = {k: named.schema[k].dataType.simpleString() for k in (*PLACE, "i")}
        return by_volumes(named, ["i", "v", "marker"], _flooded, ", ".join(f"{k} {kind[k]}" for k in ("t", "i", *AXES)) + ", label bigint, level double", bits)
    named = materialize(named.withColumn("node", F.monotonically_increasing_id()))
    nodes = named.withColumn("height", F.struct("v", "i", "node"))
    flooded = materialize(levels(nodes))
    pairs = _pairs(flooded.where("level is not null"), ["level"])
    either = pairs.select("a", "b", "level_b").union(pairs.select("b", "a", "level_a"))
    first = either.groupBy("a").agg(F.min(F.struct("level_b", "b")).alias("_first"))
    dry = flooded.where("level is not null and marker is null").join(first, F.col("node") == F.col("a"), "left")
    source = F.when(F.col("level.node") != F.col("node"), F.col("level.node")).otherwise(F.col("_first.b"))
    trees = materialize(components(dry.select(F.col("node").alias("a"), source.alias("b"))))
    root = flooded.where("marker is not null").join(trees, "node").select("component", F.col("marker").alias("_label"))
    labels = trees.join(root, "component").select(F.col("node").alias("_node"), "_label")
    done = flooded.join(labels, F.col("node") == F.col("_node"), "left")
    return done.select("t", "i", "x", "y", "z", F.coalesce("marker", "_label", F.lit(0)).alias("label"), F.col("level.v").alias("level"))
