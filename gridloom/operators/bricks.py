"""Volumes as bricks with halos: what lets numpy work on a lattice while no task holds a volume.

A piece is a box of a volume with one or more fields: (t, kind, odd, nz ny nx, z0 y0 x0, dz dy dx, then an array of doubles a
field, components first). exchange() sends every piece to each brick whose padded box it meets, cropped to that box, puts a
brick's boxes together and calls a function on it, which returns pieces again. So a step over the neighbourhood, a step to
half or double resolution and a scatter (overlapping boxes added up) are each one shuffle, whatever the volume's size; a task
holds one padded brick. Padded boxes end at the volume: what is outside is for the function to decide.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE = 32
#: The longest axis of a volume that is worked on whole, where steps are many and bricks would be sent again for each.
WHOLE = 64
BOX = ["nz", "ny", "nx", "z0", "y0", "x0", "dz", "dy", "dx"]
BRICK = ["bz", "by", "bx"]


@dataclass
class Block:
    """A box of volume t: its first voxel lo, the volume's shape n, arrays (components, z, y, x) by name.

    odd: bits (z, y, x) of the axes on which the volume of double resolution has one voxel less than twice as many.
    """

    t: int
    n: tuple[int, int, int]
    lo: tuple[int, int, int]
    fields: dict[str, np.ndarray] = field(default_factory=dict)
    kind: int = 0
    core: tuple[slice, ...] = ()
    odd: int = 0

    @property
    def shape(self) -> tuple[int, ...]:
        return next(iter(self.fields.values())).shape[1:]

    def replaced(self, name: str, array: np.ndarray) -> "Block":
        self.fields[name] = array
        return self

    def cut(self, names: Iterable[str] | dict[str, np.ndarray], kind: int = 0, grow: int = 0) -> "Block":
        """The core of some fields (or of arrays of the block's shape), grown on each side where the block has voxels."""
        whole = names if isinstance(names, dict) else {k: self.fields[k] for k in names}
        at = tuple(slice(max(s.start - grow, 0), s.stop + grow) for s in self.core)
        lo = tuple(a + s.start for a, s in zip(self.lo, at, strict=True))
        return Block(self.t, self.n, lo, {k: v[(slice(None), *at)] for k, v in whole.items()}, kind, odd=self.odd)


def held_whole(most: int, side: int, whole: int | None = None) -> bool:
    """Whether volumes of this longest axis go to one task each: by default up to two bricks an axis, so a task stays bounded."""
    return most <= (min(2 * side, WHOLE) if whole is None else whole)


def parted(block: Block, names: Iterable[str], side: int) -> Iterable[Block]:
    """A whole volume's fields as its bricks."""
    for lo in product(*(range(0, m, side) for m in block.n)):
        at = tuple(slice(a, a + side) for a in lo)
        yield Block(block.t, block.n, lo, {k: block.fields[k][(slice(None), *at)] for k in names}, odd=block.odd)


def schema(fields: Iterable[str], t: str = "bigint") -> str:
    return f"t {t}, kind int, odd int, " + ", ".join(f"{c} int" for c in BOX) + "".join(f", {f} array<double>" for f in fields)


def _rows(blocks: list[Block], fields: list[str], targets: list[tuple[int, int, int]] | None = None):
    import pyarrow as pa

    columns = [pa.array([b.t for b in blocks], pa.int64()), pa.array([b.kind for b in blocks], pa.int32()), pa.array([b.odd for b in blocks], pa.int32())]
    for k in range(9):
        columns.append(pa.array([(*b.n, *b.lo, *b.shape)[k] for b in blocks], pa.int32()))
    for name in fields:
        arrays = [b.fields.get(name) for b in blocks]
        at = np.cumsum([0, *(0 if a is None else a.size for a in arrays)])
        flat = np.concatenate([np.ascontiguousarray(a, float).ravel() for a in arrays if a is not None] or [np.zeros(0)])
        offsets = pa.array(at, pa.int32(), mask=np.array([*(a is None for a in arrays), False]))
        columns.append(pa.ListArray.from_arrays(offsets, pa.array(flat)))
    names = ["t", "kind", "odd", *BOX, *fields]
    if targets is not None:
        columns += [pa.array([x[k] for x in targets], pa.int32()) for k in range(3)]
        names += BRICK
    return pa.RecordBatch.from_arrays(columns, names)


def _blocks(batch, fields: list[str]) -> Iterable[Block]:
    """The rows of an Arrow batch as blocks."""
    if not batch.num_rows:
        return
    plain = {c: batch.column(c).to_pylist() for c in ("t", "kind", "odd", *BOX)}
    lists = {}
    for name in fields:
        column = batch.column(name)
        column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
        lists[name] = (column.is_valid().to_pylist(), column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False))
    for k in range(batch.num_rows):
        box = [plain[c][k] for c in BOX]
        made = Block(plain["t"][k], tuple(box[:3]), tuple(box[3:6]), kind=plain["kind"][k], odd=plain["odd"][k])
        for name, (valid, at, values) in lists.items():
            if valid[k]:
                made.fields[name] = values[at[k] : at[k + 1]].reshape(-1, *box[6:])
        yield made


def exchange(pieces: DataFrame, fields: dict[str, int], out: list[str], run: Callable[[Block], Iterable[Block]], halo: int = 0, side: int = SIDE, add: bool = False) -> DataFrame:
    """run() on every brick with its fields (by name, with their components; zero where no piece has them), padded by halo.

    add: boxes that overlap are summed, not pasted. The result is what run returns, as pieces with the fields `out`.
    """
    names = list(fields)

    def scatter(batches):
        for batch in batches:
            made, targets = [], []
            for piece in _blocks(batch, names):
                spans = []
                for lo, size, n in zip(piece.lo, piece.shape, piece.n, strict=True):
                    first, last = max(lo - halo, 0) // side, min(lo + size - 1 + halo, n - 1) // side
                    spans.append([(b, max(lo, b * side - halo), min(lo + size, (b + 1) * side + halo)) for b in range(first, last + 1)])
                for boxes in product(*spans):
                    if all(a < e for _, a, e in boxes):
                        at = tuple(slice(a - lo, e - lo) for (_, a, e), lo in zip(boxes, piece.lo, strict=True))
                        made.append(Block(piece.t, piece.n, tuple(a for _, a, _ in boxes), {k: v[(slice(None), *at)] for k, v in piece.fields.items()}, odd=piece.odd))
                        targets.append(tuple(b for b, _, _ in boxes))
            if made:
                yield _rows(made, names, targets)

    def gather(key, table):
        t, *brick = (k.as_py() for k in key)
        found = list(_blocks(table.combine_chunks().to_batches()[0], names))
        n = found[0].n
        first = tuple(b * side for b in brick)
        lo = tuple(max(a - halo, 0) for a in first)
        hi = tuple(min(a + side + halo, m) for a, m in zip(first, n, strict=True))
        whole = Block(t, n, lo, {k: np.zeros((c, *(b - a for a, b in zip(lo, hi, strict=True)))) for k, c in fields.items()}, odd=max(p.odd for p in found))
        whole.core = tuple(slice(a - b, min(a + side, m) - b) for a, b, m in zip(first, lo, n, strict=True))
        for piece in found:
            at = tuple(slice(a - b, a - b + s) for a, b, s in zip(piece.lo, lo, piece.shape, strict=True))
            for k, v in piece.fields.items():
                if add:
                    whole.fields[k][(slice(None), *at)] += v
                else:
                    whole.fields[k][(slice(None), *at)] = v
        import pyarrow as pa

        return pa.Table.from_batches([_rows(list(run(whole)), out)])

    sent = pieces.select("t", "kind", "odd", *BOX, *names).mapInArrow(scatter, schema(names) + "".join(f", {b} int" for b in BRICK))
    return sent.groupBy("t", *BRICK).applyInArrow(gather, schema(out))


def bricks(voxels: DataFrame, fields: dict[str, list[str]], shape: tuple[int, int, int], side: int = SIDE) -> DataFrame:
    """Pieces of voxels (t, x, y, z, ...) of volumes of this shape (nx, ny, nz): each field from some columns; null or absent is 0."""
    nx, ny, nz = shape
    divided = voxels.select("t", *[F.floor(F.col(a) / side).cast("int").alias(f"b{a}") for a in "zyx"], "x", "y", "z", *{c for cs in fields.values() for c in cs})

    def build(key, table):
        import pyarrow as pa

        t, *brick = (k.as_py() for k in key)
        lo = tuple(b * side for b in brick)
        size = tuple(min(side, n - a) for n, a in zip((nz, ny, nx), lo, strict=True))
        at = tuple(table.column(c).to_numpy() - a for c, a in zip("zyx", lo, strict=True))
        made = Block(t, (nz, ny, nx), lo)
        for name, columns in fields.items():
            made.fields[name] = np.zeros((len(columns), *size))
            for k, c in enumerate(columns):
                made.fields[name][(k, *at)] = np.nan_to_num(table.column(c).to_numpy().astype(float))
        return pa.Table.from_batches([_rows([made], list(fields))])

    return divided.groupBy("t", "bz", "by", "bx").applyInArrow(build, schema(fields))


def voxels(pieces: DataFrame, fields: dict[str, list[str]]) -> DataFrame:
    """The voxels (t, i, x, y, z and a column a component) of pieces that don't overlap."""

    def flat(batches):
        import pyarrow as pa

        for batch in batches:
            for b in _blocks(batch, list(fields)):
                z, y, x = (g.ravel() + a for g, a in zip(np.indices(b.shape), b.lo, strict=True))
                made = [pa.array(np.full(len(x), b.t)), *(pa.array(c.astype(np.int32)) for c in (x + b.n[2] * (y + b.n[1] * z), x, y, z))]
                made += [pa.array(np.ascontiguousarray(b.fields[f][k], float).ravel()) for f, cs in fields.items() for k in range(len(cs))]
                yield pa.RecordBatch.from_arrays(made, ["t", "i", "x", "y", "z", *(c for cs in fields.values() for c in cs)])

    return pieces.mapInArrow(flat, "t bigint, i int, x int, y int, z int" + "".join(f", {c} double" for cs in fields.values() for c in cs))
