"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

A unit is a run of letters, digits or other signs. Each of BUCKETS hashed units has a sparse ternary index vector (a
vocabulary of V words has V / BUCKETS words a bucket, 488 at a million; frequent ones decide a bucket's vector); its
context vector is the sum of the index vectors of all its neighbours up to SPAN units away in the whole corpus. A
document is the mean of its units' normed context vectors and index vectors, with the norms of both means, the share of
units that return one and two places on, and the logarithm of their number. A network of two layers, trained in numpy
on at most TRAIN labelled rows (those with the least hashed ids), gives a logit, which a temperature fitted on a fifth of these
rows calibrates. Only the text is an input of the score.

A null or empty text is the zero vector and gets the network's score of that; texts of any length are pooled whole. A
null id counts as held out (like an id whose text is empty); repeated rows are scored each on its own; labels that
disagree on an id count as the least, null labels not at all; of several rows with one id one is learned from. Without both classes to learn from, the score is the
share of ones, smoothed. An empty table gives an empty table. Other columns pass through; the operator's own replace
equal names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridloom.llm.common import flat_bytes, mix64, others, read_table, small_batches, span_hashes

BUCKETS, DIM, SPAN, TRAIN, HIDDEN = 2048, 32, 2, 20000, 24
THRESHOLD = 0.3

#: Kinds of bytes: white space, letters (and all of a multi-byte sign), digits, other signs.
_KIND = np.full(256, 3, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def index_places() -> tuple[np.ndarray, np.ndarray]:
    """Four places of each bucket's index vector and the signs there, from a hash alone."""
    spots = mix64(np.arange(BUCKETS * 4, dtype=np.uint64) + np.uint64(77)).reshape(BUCKETS, 4)
    return (spots % np.uint64(DIM)).astype(np.int64), np.where(spots >> np.uint64(63), 1, -1)


def index_vectors() -> np.ndarray:
    """BUCKETS x DIM of -1, 0, 1."""
    places, signs = index_places()
    out = np.zeros((BUCKETS, DIM), np.float32)
    for k in range(4):
        out[np.arange(BUCKETS), places[:, k]] = signs[:, k]
    return out


def units(column) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every unit of a string column, and the n + 1 offsets of its rows."""
    raw, at = flat_bytes(column)
    kind = _KIND[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[[0, -1]] = True
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[at] = True
    cuts = np.flatnonzero(edge)
    if len(cuts) < 2:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = kind[cuts[:-1]] > 0
    starts, ends = cuts[:-1][solid], cuts[1:][solid]
    return (span_hashes(raw, starts, ends) % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(starts, at)


def _contexts(batches):
    """This partition's part of all context vectors, as whole numbers: any partitioning adds up to the same."""
    import pyarrow as pa

    sums = np.zeros((BUCKETS, DIM), np.int64)
    places, signs = index_places()
    for k in range(1, 4):  # the last of equal places is the one that counts
        for j in range(k):
            signs[:, j] *= places[:, j] != places[:, k]
    for batch in small_batches(batches, "text"):
        ids, at = units(batch.column(0))
        owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for gap in range(1, SPAN + 1):
            near = owner[gap:] == owner[:-gap]
            left, right = ids[:-gap][near], ids[gap:][near]
            for own, other in ((left, right), (right, left)):
                for k in range(4):
                    sums += np.bincount(own * DIM + places[other, k], signs[other, k], BUCKETS * DIM).astype(np.int64).reshape(BUCKETS, DIM)
    seen = np.flatnonzero(sums.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.FixedSizeListArray.from_arrays(pa.array(sums[seen].ravel()), DIM).cast(pa.list_(pa.int64()))], ["bucket", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x 2 DIM: normed context and index vectors, the former from all documents."""
    parts = docs.select("text").mapInArrow(_contexts, "bucket long, sums array<long>")
    context = np.zeros((BUCKETS, DIM))
    total = parts.groupBy("bucket").agg(*(F.sum(F.col("sums")[d]).alias(f"d{d}") for d in range(DIM))).toArrow()  # BUCKETS rows at most
    context[total.column("bucket").to_numpy()] = np.column_stack([total.column(f"d{d}").to_numpy() for d in range(DIM)])
    context /= np.maximum(np.sqrt((context**2).sum(1)), 1e-9)[:, None]
    return np.hstack([context, index_vectors() / 2]).astype(np.float32)


def pooled(column, vectors: np.ndarray) -> np.ndarray:
    """The documents' vectors, 2 DIM + 5 wide."""
    ids, at = units(column)
    out = np.zeros((len(at) - 1, vectors.shape[1]), np.float32)
    step = 1 << 16
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for i in range(0, len(ids), step):
        own = owner[i : i + step]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        out[own[first]] += np.add.reduceat(vectors[ids[i : i + step]], first, axis=0)
    n = np.maximum(np.diff(at), 1)[:, None]
    out /= n
    norms = [np.sqrt((part**2).sum(1)) for part in (out[:, :DIM], out[:, DIM:])]
    again = []
    for gap in (1, 2):
        same = (ids[gap:] == ids[:-gap]) & (owner[gap:] == owner[:-gap])
        again.append(np.bincount(owner[gap:][same], minlength=len(out)) / n[:, 0])
    return np.column_stack([out, *norms, *again, np.log1p(np.diff(at))])


class Network:
    """tanh layer, logistic output, inputs standardised; trained by Adam on the cross entropy."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.rate = (y.sum() + 1) / (len(y) + 2)
        self.trained = len(np.unique(y)) == 2
        if not self.trained:
            return
        held = rng.random(len(y)) < 0.2
        if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
            held[:] = False
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = (x - self.mean) / self.scale
        w = [rng.normal(size=(x.shape[1], HIDDEN)) / np.sqrt(x.shape[1]), np.zeros(HIDDEN), rng.normal(size=HIDDEN) / np.sqrt(HIDDEN), np.zeros(1)]
        first, second, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        fit = np.flatnonzero(~held)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                h = np.tanh(z[part] @ w[0] + w[1])
                p = 1 / (1 + np.exp(-(h @ w[2] + w[3])))
                d = (p - y[part]) / len(part)
                back = np.outer(d, w[2]) * (1 - h * h)
                grads = [z[part].T @ back + 1e-4 * w[0], back.sum(0), h.T @ d + 1e-4 * w[2], np.array([d.sum()])]
                step += 1
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    w[k] = w[k] - 0.003 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if held.any():
            logits = self.logit(x[held])
            losses = {t: np.logaddexp(0, np.where(y[held] > 0, -logits, logits) / t).mean() for t in np.geomspace(0.25, 8, 61)}
            self.temperature = float(min(losses, key=losses.get))

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trained:
            return np.full(len(x), self.rate)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def labelled(labels: DataFrame, name: str, most: int) -> DataFrame:
    """(doc_id, label): at most `most` rows to learn from, those with the least hashed ids."""
    known = labels.where(F.col(name).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.min(name).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score and predicted."""
    vectors = word_vectors(docs)
    spark = docs.sparkSession
    sample = spark.createDataFrame(labelled(labels, "quality", TRAIN).collect(), "doc_id long, label int")  # TRAIN rows at most

    def features(batches):
        import pyarrow as pa

        for batch in small_batches(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pooled(batch.column(2), vectors).tolist(), pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text").mapInArrow(features, "doc_id long, label int, x array<double>")
    rows = found.groupBy("doc_id", "label").agg(F.min("x").alias("x")).orderBy("doc_id").collect()  # TRAIN rows at most
    network = Network(np.array([r.x for r in rows]).reshape(len(rows), 2 * DIM + 5), np.array([r.label for r in rows], float))

    def scores(batches):
        import pyarrow as pa

        for batch in small_batches(batches, "text"):
            x = pooled(batch.column("text"), vectors).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(network.score(x))], [*batch.schema.names, "score"])

    own = ("held_out", "score", "predicted")
    kept = docs.select(*[f"`{c}`" for c in others(docs.columns, own)])
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])
    scored = kept.mapInArrow(scores, schema)
    return scored.select(*[f"`{c}`" for c in kept.columns], held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
