"""Toxicity: a bidirectional gated recurrent network with attention pooling, over word and character inputs, in numpy.

A word is a run of letters and digits (A-Z lower-cased); a run of more than UNIT bytes, such as a compound or a clause
without spaces, is cut into words of UNIT bytes (to whole characters), each half over the last. A word's input is the
learned vector of its hash beside the sum of the learned vectors of its first 3 to 8 and last 3 and 4 bytes and of any
INNER bytes of it, wherever they stand. Windows of WINDOW words, each half over the last, cover
the whole text, and every one is scored. A small logistic layer turns a document's window scores (largest, second, mean,
expected number of toxic windows) into its score.

Learning uses at most TRAIN rows of each label, those with the least hashed ids, and of these no more than LEARNED bytes of
text, one row of an id. A toxic document's label holds for its
most toxic window only, so in each round the windows that the network finds most toxic are learned, of clean documents
too. A fifth of the rows is kept from the network to fit the document layer, weighted back to the labels' true shares.

A null or empty text, or one without words, has one empty window. A null id counts as held out; repeated rows are scored
each on its own; labels that disagree on an id count as the least, null labels not at all. Without both classes to learn
from, the score is the smoothed share of ones. An empty table gives an empty table. Other columns pass through score();
the operator's own replace equal names.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from gridloom.llm.common import _LOWER, flat_bytes, others, read_table, small_batches, span_hashes
from gridloom.llm.quality import _KIND, held_out

WINDOW, STRIDE, HIDDEN = 64, 32, 12
WORD_BUCKETS, WORD_DIM, CHAR_BUCKETS, CHAR_DIM = 16384, 8, 16384, 12
PREFIXES, SUFFIXES = (3, 4, 5, 6, 7, 8), (3, 4)
UNIT, INNER = 12, 5
TRAIN, LEARNED, ROUNDS = 2400, 64 << 20, 9
THRESHOLD = 0.5


def _units(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words as they are up to UNIT bytes; longer ones cut every half UNIT, from and to whole characters (3 bytes more on either side)."""
    count = np.maximum(1, -(-(ends - starts - UNIT) // (UNIT // 2)) + 1)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    low, high = np.repeat(starts, count), np.repeat(ends, count)
    a = low + k * (UNIT // 2)
    b = np.minimum(a + UNIT, high)
    for _ in range(3):
        a = np.where((a > low) & (raw[np.minimum(a, len(raw) - 1)] >> 6 == 2), a - 1, a)
        b = np.where((b < high) & (raw[np.minimum(b, len(raw) - 1)] >> 6 == 2), b + 1, b)
    return a, b


class Words:
    """A string column as numbers of distinct words: ids of all words, offsets of rows, and each distinct word's buckets."""

    def __init__(self, column) -> None:
        raw, at = flat_bytes(column)
        solid = (_KIND[raw] == 1) | (_KIND[raw] == 2)
        edge = np.zeros(len(raw) + 1, bool)
        edge[1:-1] = solid[1:] != solid[:-1]
        edge[at] = True
        edge[[0, -1]] = True
        cuts = np.flatnonzero(edge)
        keep = solid[cuts[:-1]] if len(cuts) > 1 else np.zeros(0, bool)
        starts, ends = (cuts[:-1][keep], cuts[1:][keep]) if len(cuts) > 1 else (np.zeros(0, np.int64),) * 2
        starts, ends = _units(raw, starts, ends)
        low = _LOWER[raw]
        hashes = span_hashes(low, starts, ends)
        _, first, self.ids = np.unique(hashes, return_index=True, return_inverse=True)
        self.at = np.searchsorted(starts, at)
        order = np.argsort(first)
        s, e = starts[first[order]], ends[first[order]]
        self.words = np.zeros(len(first), np.int64)
        self.words[order] = (hashes[first[order]] % np.uint64(WORD_BUCKETS)).astype(np.int64)
        self.grams = np.zeros((len(first), len(PREFIXES) + len(SUFFIXES) + UNIT + 6 - INNER + 1), np.int64)
        for k, n in enumerate(PREFIXES + SUFFIXES):
            a, b = (s, np.minimum(s + n, e)) if k < len(PREFIXES) else (np.maximum(e - n, s), e)
            bucket = (span_hashes(low, a, b) ^ np.uint64(k * 0x9E37)) % np.uint64(CHAR_BUCKETS - 1) + np.uint64(1)
            self.grams[order, k] = np.where(e - s >= n, bucket.astype(np.int64), 0)
        for k in range(UNIT + 6 - INNER + 1):
            a = np.minimum(s + k, e)
            bucket = (span_hashes(low, a, np.minimum(a + INNER, e)) ^ np.uint64(0xA5A5)) % np.uint64(CHAR_BUCKETS - 1) + np.uint64(1)
            self.grams[order, len(PREFIXES) + len(SUFFIXES) + k] = np.where(a + INNER <= e, bucket.astype(np.int64), 0)

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(n, WINDOW) word numbers, the number after the last standing for none, and each window's row."""
        n = np.diff(self.at)
        count = np.maximum(1, -(-(n - WINDOW) // STRIDE) + 1)
        row = np.repeat(np.arange(len(n)), count)
        k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        place = (k * STRIDE).astype(np.int32)[:, None] + np.arange(WINDOW, dtype=np.int32)
        inside = place < n[row].astype(np.int32)[:, None]
        place += self.at[row].astype(np.int32)[:, None]
        place[~inside] = len(self.ids)
        return np.append(self.ids, len(self.words)).astype(np.int32)[place], row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """The recurrent network; p holds all its parameters by name."""

    def __init__(self, seed: int = 5, kind=np.float32) -> None:
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        self.p = {"word": rng.normal(size=(WORD_BUCKETS, WORD_DIM)) * 0.1, "char": rng.normal(size=(CHAR_BUCKETS, CHAR_DIM)) * 0.1, "look": rng.normal(size=2 * h) * 0.5, "out": rng.normal(size=2 * h) * 0.5, "bias": np.zeros(1)}
        for k in (0, 1):
            self.p |= {f"in{k}": rng.normal(size=(d, 3 * h)) / np.sqrt(d), f"rec{k}": rng.normal(size=(h, 3 * h)) / np.sqrt(h), f"off{k}": np.zeros(3 * h)}
        self.p["char"][0] = 0
        self.p = {k: v.astype(kind) for k, v in self.p.items()}

    def inputs(self, words: np.ndarray, grams: np.ndarray) -> np.ndarray:
        chars = self.p["char"][grams[:, 0]]
        for k in range(1, grams.shape[1]):
            chars = chars + self.p["char"][grams[:, k]]
        return np.hstack([self.p["word"][words], chars])

    def project(self, x: np.ndarray) -> list[np.ndarray]:
        """Gate inputs of each distinct word for both directions; a row of zeros more for none."""
        return [np.vstack([x @ self.p[f"in{k}"] + self.p[f"off{k}"], np.zeros((1, 3 * HIDDEN), x.dtype)]) for k in (0, 1)]

    def forward(self, ids: np.ndarray, gates: list[np.ndarray], keep: bool = False):
        """Logit of each window, and what backward() needs."""
        n, steps = ids.shape
        h = HIDDEN
        none = len(gates[0]) - 1
        real = ids != none
        states = np.zeros((steps, n, 2 * h), gates[0].dtype)
        kept = []
        for k in (0, 1):
            state = np.zeros((n, h), gates[0].dtype)
            for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
                x, u = gates[k][ids[:, t]], state @ self.p[f"rec{k}"]
                zr = _sigmoid(x[:, : 2 * h] + u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
                after = np.where(real[:, t, None], new + z * (state - new), state)
                if keep:
                    kept.append((k, t, state, z, r, new, u[:, 2 * h :]))
                state = after
                states[t, :, k * h : (k + 1) * h] = state
        looks = np.where(real.T, states @ self.p["look"], -1e4)
        weight = np.exp(looks - looks.max(0))
        weight = np.where(real.T, weight, 0)
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = np.einsum("tn,tnd->nd", weight, states)
        return pooled @ self.p["out"] + self.p["bias"], (ids, real, states, weight, pooled, kept)

    def backward(self, d: np.ndarray, x: np.ndarray, words: np.ndarray, grams: np.ndarray, held) -> dict[str, np.ndarray]:
        """Gradients of all parameters for the gradient d of the logits."""
        ids, real, states, weight, pooled, kept = held
        h = HIDDEN
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["bias"] = pooled.T @ d, np.array([d.sum()], d.dtype)
        to_pool = d[:, None] * self.p["out"]
        to_weight = np.einsum("nd,tnd->tn", to_pool, states)
        to_look = weight * (to_weight - (weight * to_weight).sum(0))
        g["look"] = np.einsum("tn,tnd->d", to_look, states)
        to_states = weight[:, :, None] * to_pool + to_look[:, :, None] * self.p["look"]
        gate = [np.zeros((*ids.shape, 3 * h), x.dtype) for _ in (0, 1)]
        back = [np.zeros((len(ids), h), x.dtype) for _ in (0, 1)]
        for k, t, state, z, r, new, u in reversed(kept):
            full = back[k] + to_states[t, :, k * h : (k + 1) * h]
            own = np.where(real[:, t, None], full, 0)
            dn = own * (1 - z) * (1 - new * new)
            dz = own * (state - new) * z * (1 - z)
            dr = dn * u * r * (1 - r)
            rec = np.hstack([dz, dr, dn * r])
            gate[k][:, t] = np.hstack([dz, dr, dn])
            g[f"rec{k}"] += state.T @ rec
            back[k] = np.where(real[:, t, None], own * z + rec @ self.p[f"rec{k}"].T, full)
        flat = ids.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
        seen = flat[order][first]
        at = seen < len(words)
        to_x = np.zeros((at.sum(), x.shape[1]), x.dtype)
        for k in (0, 1):
            sums = np.add.reduceat(gate[k].reshape(-1, 3 * h)[order], first, axis=0)[at]
            g[f"in{k}"], g[f"off{k}"] = x[seen[at]].T @ sums, sums.sum(0)
            to_x += sums @ self.p[f"in{k}"].T
        np.add.at(g["word"], words[seen[at]], to_x[:, :WORD_DIM])
        for k in range(grams.shape[1]):
            np.add.at(g["char"], grams[seen[at], k], to_x[:, WORD_DIM:])
        g["char"][0] = 0
        return g

    def logits(self, words: Words, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Logit and row of every window."""
        gates = self.project(self.inputs(words.words, words.grams))
        ids, row = words.windows()
        return np.concatenate([self.forward(ids[i : i + step], gates)[0] for i in range(0, len(ids), step)] or [np.zeros(0)]), row


def summary(logits: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Of each document: its largest and second window logit, the logit of the mean and the log of the sum of chances."""
    logits = np.clip(logits.astype(np.float64), -8, 8)
    order = np.lexsort((-logits, row))
    first = np.searchsorted(row[order], np.arange(rows))
    count = np.bincount(row, minlength=rows)
    top = logits[order][first]
    second = np.where(count > 1, logits[order][np.minimum(first + 1, len(order) - 1)], -8.0)
    total = np.bincount(row, _sigmoid(logits), minlength=rows)
    mean = np.clip(total / count, 1e-4, 1 - 1e-4)
    return np.column_stack([top, second, np.log(mean / (1 - mean)), np.log(total + 1e-3)])


class Scorer:
    """The trained network and its document layer."""

    def __init__(self, texts, y: np.ndarray, shares: tuple[float, float], rounds: int = ROUNDS, seed: int = 3) -> None:
        self.rate = shares[1]
        self.net = None
        if len(np.unique(y)) < 2:
            return
        rng = np.random.default_rng(seed)
        words = Words(texts)
        held = rng.random(len(y)) < 0.2
        if len(np.unique(y[held])) < 2 or len(np.unique(y[~held])) < 2:
            held[:] = False
        self.net = net = Network()
        ids, row = words.windows()
        first, second, step = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2)), None, 0
        first, second = first
        fit = np.flatnonzero(~held[row])
        for turn in range(rounds):
            luck = rng.random(len(fit))
            if turn:
                gates = net.project(net.inputs(words.words, words.grams))
                worth = np.concatenate([net.forward(ids[fit[i : i + 4096]], gates)[0] for i in range(0, len(fit), 4096)])
            else:
                worth = luck
            best = fit[_firsts(row[fit], -worth)]
            other = fit[_firsts(row[fit], luck)]
            chosen = np.unique(np.concatenate([best, other[y[row[other]] == 0] if turn else other]))
            for part in np.array_split(rng.permutation(chosen), max(1, len(chosen) // 128)):
                used, local = np.unique(ids[part], return_inverse=True)
                real = used[used < len(words.words)]
                local = np.where(used[local] < len(words.words), local, len(real)).reshape(len(part), WINDOW)
                x = net.inputs(words.words[real], words.grams[real])
                logit, kept = net.forward(local, net.project(x), True)
                d = ((_sigmoid(logit) - y[row[part]]) / len(part)).astype(x.dtype)
                step += 1
                for k, g in net.backward(d, x, words.words[real], words.grams[real], kept).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    net.p[k] -= (0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(g.dtype)
        at = np.flatnonzero(held) if held.any() else np.arange(len(y))
        logits, row = net.logits(words)
        x = summary(logits, row, len(y))[at]
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        weight = np.where(y[at] > 0, shares[1] / max(1e-9, (y[at] > 0).mean()), shares[0] / max(1e-9, (y[at] <= 0).mean()))
        self.layer = np.zeros(z.shape[1])
        for _ in range(30):
            p = _sigmoid(z @ self.layer)
            hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(z.shape[1])
            self.layer -= np.linalg.solve(hess, z.T @ (weight * (p - y[at])) + 0.05 * self.layer)

    def score(self, column) -> np.ndarray:
        if self.net is None:
            return np.full(len(column), self.rate)
        logits, row = self.net.logits(Words(column))
        z = (summary(logits, row, len(column)) - self.mean) / self.scale
        return _sigmoid(np.clip(z @ self.layer[:-1] + self.layer[-1], -50, 50))


def _firsts(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each group's element with the least key."""
    order = np.lexsort((key, group))
    return order[np.flatnonzero(np.r_[True, group[order][1:] != group[order][:-1]])] if len(order) else order


def _sample(labels: DataFrame) -> tuple[list, tuple[float, float]]:
    """At most TRAIN ids of each label to learn from, and the shares of both labels among all such rows, smoothed."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("label"))
    ones = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN).collect() for k in (0, 1)]
    n = [known.where(F.col("label") == k).count() + 1 for k in (0, 1)]
    return ones[0] + ones[1], (n[0] / sum(n), n[1] / sum(n))


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    import pyarrow as pa

    rows, shares = _sample(labels)
    sample = F.broadcast(docs.sparkSession.createDataFrame(rows, "doc_id long, label int"))  # 2 TRAIN rows at most
    known = docs.select("doc_id", "text").join(sample, "doc_id")
    sizes = known.groupBy("doc_id", "label").agg(F.min(F.struct(F.coalesce(F.octet_length("text"), F.lit(0)), F.xxhash64("text"))).alias("one")).collect()
    sizes.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    taken, left = [], LEARNED
    for r in sizes:
        if r.one[0] <= left:  # a text that no longer fits is passed over, shorter ones after it are not
            taken.append((r.doc_id, r.label, r.one[1]))
            left -= r.one[0]
    if not taken:
        return Scorer(pa.array([], pa.string()), np.zeros(0), shares)
    taken = F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long, label int, hash long"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).join(taken, ["doc_id", "hash"]).groupBy("doc_id", "label").agg(F.first("text").alias("text"))
    found = texts.orderBy("doc_id").collect()  # LEARNED bytes at most
    return Scorer(pa.array([r.text for r in found], pa.string()), np.array([r.label for r in found], float), shares)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score and predicted."""
    scorer = train(docs, labels)

    def scores(batches):
        import pyarrow as pa

        for batch in small_batches(batches, "text", 2 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scorer.score(batch.column("text")))], [*batch.schema.names, "score"])

    own = ("held_out", "score", "predicted")
    kept = docs.select(*[f"`{c}`" for c in others(docs.columns, own)])
    scored = kept.mapInArrow(scores, StructType([*kept.schema.fields, StructField("score", DoubleType())]))
    return scored.select(*[f"`{c}`" for c in kept.columns], held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
