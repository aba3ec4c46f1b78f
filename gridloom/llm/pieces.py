"""SentencePiece encoding and decoding with a BPE model's pieces, by suffix-array matching and relaxation.

A batch's new distinct segments (a run of spaces and the run of other signs after it; no piece reaches over such an edge)
are joined to one text. Its suffixes are sorted by as many bytes as the longest piece has; each piece is binary-searched
for the range of suffixes that start with it, and every occurrence is an edge from its start to its end. Edges are taken
in order of their end and relaxed: an edge is taken up if the token that ends where it starts may stand before it, which
holds for one edge of each place at most, because a BPE result's beginning up to a token's end is the BPE result of that
beginning. Two tokens may stand side by side if merging their joint signs gives just these two. So the ids are those of
the merge procedure itself. Signs without a piece become byte pieces.

The model file is a parameter, read on the driver and sent to the tasks (half a MB). Models with a normaliser or of another
kind are refused. A null text has no ids, like an empty one; texts of any length are encoded whole; repeated rows are
encoded each on its own; segments are told apart by their bytes, hashes only find them; an empty table gives an empty table. Other columns pass through; the operator's own (ids,
n_tokens, decoded) replace equal names. A lower one eighth block (U+2581) reads as a blank, as in the format itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gridloom.llm.common import flat_bytes, others, read_table, small_batches, span_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Segments of more bytes are relaxed one by one, shorter ones side by side.
LONG = 96
_MEMO = 1 << 21
#: Distinct segments whose ids a process remembers before it starts anew.
KNOWN = 1 << 19
#: Bytes of new segments that are matched at once.
CHUNK = 1 << 18


def _fields(data: bytes):
    """(number, value) of the fields of a protocol buffer message."""

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift += 7
            i += 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        tag, i = varint(i)
        if tag & 7 == 0:
            value, i = varint(i)
        else:
            size, i = varint(i) if tag & 7 == 2 else ({1: 8, 5: 4}[tag & 7], i)
            value = data[i : i + size]
            i += size
        yield tag >> 3, value


class Model:
    """Pieces with scores, what may stand side by side, and the arrays that matching needs."""

    def __init__(self, data: bytes) -> None:
        self.pieces, scores, kinds, bpe, plain = [], [], [], False, False
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                scores.append(float(np.frombuffer(own.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(own.get(3, 1))
            elif number == 2:
                bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                own = dict(_fields(value))
                plain = own.get(1) == b"identity" and own.get(3, 1) == 1 and own.get(4, 1) == 0
        self.bytes_of = np.zeros(256, np.int32)
        for i, kind in enumerate(kinds):
            if kind == 6:
                self.bytes_of[int(self.pieces[i][3:5], 16)] = i
        self.score = {p: s for p, s, k in zip(self.pieces, scores, kinds, strict=True) if k == 1}
        single = {p for p in self.score if len(p) == 1}
        if not (bpe and plain and kinds.count(6) == 256) or any(k in (4, 5) for k in kinds) or any(set(p) - single or BLANK in p.lstrip(BLANK) for p in self.score):
            raise ValueError("only BPE models with byte pieces, the identity normaliser and blanks before words are known")
        self.none, self.start, self.other = -1, len(self.pieces), len(self.pieces) + 1
        normal = [i for i, k in enumerate(kinds) if k == 1]
        spelled = [self.pieces[i].replace(BLANK, " ").encode() for i in normal]
        self.ids, self.sizes = np.array(normal), np.array([len(s) for s in spelled])
        self.keys = -(-max(map(len, spelled)) // 8)
        packed = np.frombuffer(b"".join(s.ljust(8 * self.keys, b"\0") for s in spelled), ">u8").reshape(-1, self.keys)
        self.packed = packed.astype(np.uint64)
        self.memo_key, self.memo_value = np.full(_MEMO, -1, np.int64), np.zeros(_MEMO, bool)
        self.forget()
        raw = [bytes([int(p[3:5], 16)]) if k == 6 else p.replace(BLANK, " ").encode() if k == 1 else b"" for p, k in zip(self.pieces, kinds, strict=True)]
        self.raw, self.raw_at = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]

    def forget(self) -> None:
        """Empty the memory of segments: their hashes in order, where their ids and bytes are, and these."""
        self.seen = np.zeros(0, np.uint64)
        self.seen_at, self.seen_n, self.spelled_at, self.spelled_n = (np.zeros(0, np.int64) for _ in range(4))
        self.seen_ids, self.spelled = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def adjacent(self, a: int, b: int) -> bool:
        """Whether merging the signs of both tokens gives these two; a == start: whether b's signs give b."""
        if a == self.other or b == self.other:
            return b == self.other or self.adjacent(self.start, b)
        left = "" if a == self.start else self.pieces[a]
        right = self.pieces[b]
        if left + right in self.score and left:
            return False
        parts, edge, score = list(left + right), len(left), self.score
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            if sum(map(len, parts[: at + 1])) == edge and left:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts == ([left, right] if left else [right])

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """adjacent() of many pairs, remembered in a table of fixed size."""
        key = a.astype(np.int64) * (self.other + 1) + b
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)
        missing = np.flatnonzero(self.memo_key[slot] != key)
        out = self.memo_value[slot]
        if len(missing):
            fresh, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
            values = np.array([self.adjacent(int(a[i]), int(b[i])) for i in missing[first]])
            out[missing] = values[back]
            self.memo_key[slot[missing[first]]], self.memo_value[slot[missing[first]]] = fresh, values
        return out

    def edges(self, text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, token) of every occurrence of a piece in the joined segments; ends: the end of each byte's segment."""
        n = len(text)
        word = np.zeros(n + 8 * self.keys, np.uint64)
        word[:n] = text
        for width in (1, 2, 4):  # eight bytes from each place on
            word[:-width] = (word[:-width] << np.uint64(8 * width)) | word[width:]
        room = ends - np.arange(n)
        inside = np.array([0, *((((1 << 8 * k) - 1) << (64 - 8 * k)) for k in range(1, 9))], np.uint64)
        keys = [word[8 * k : 8 * k + n] & inside[np.clip(room - 8 * k, 0, 8)] for k in range(self.keys)]
        order = np.lexsort(keys[::-1])
        keys = [k[order] for k in keys]
        lo, hi = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        bits = (np.uint64(8) * (8 - np.minimum(self.sizes, 8)).astype(np.uint64)) % np.uint64(64)
        below = self.packed[:, 0] | np.where(self.sizes < 8, (np.uint64(1) << bits) - np.uint64(1), np.uint64(0))
        lo = np.searchsorted(keys[0], self.packed[:, 0], "left")
        hi = np.searchsorted(keys[0], below, "right")
        for i in np.flatnonzero((self.sizes > 8) & (hi > lo)):
            a, b, size = lo[i], hi[i], int(self.sizes[i])
            for k in range(1, -(-size // 8)):
                first = int(self.packed[i, k])
                last = first | ((1 << 8 * max(0, 8 * (k + 1) - size)) - 1)
                a, b = a + np.searchsorted(keys[k][a:b], np.uint64(first), "left"), a + np.searchsorted(keys[k][a:b], np.uint64(last), "right")
            lo[i], hi[i] = a, b
        count = hi - lo
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)
        start = order[place]
        token = np.repeat(self.ids, count)
        end = start + np.repeat(self.sizes, count)
        head = np.flatnonzero((text & 0xC0) != 0x80)
        tail = np.r_[head[1:], n]
        known = np.zeros(n + 1, bool)
        after = np.zeros(n + 1, np.int64)
        after[head] = tail
        known[start[end == after[start]]] = True
        lone = ~known[head]
        return np.r_[start, head[lone]], np.r_[end, tail[lone]], np.r_[token, np.full(lone.sum(), self.other)]

    def encode_segments(self, text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments text[at[i]:at[i+1]] in turn, and the n + 1 offsets of theirs."""
        n = len(text)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        size = np.diff(at)
        begins, ends = np.repeat(at[:-1], size), np.repeat(at[1:], size)
        start, end, token = self.edges(text, ends)
        offset = end - begins[start]
        last, came, made = np.full(n + len(size) + 1, -1, np.int64), np.zeros(n + len(size) + 1, np.int64), np.zeros(n + len(size) + 1, np.int64)
        shift = np.repeat(np.arange(len(size)), size)  # each segment has a place of its own before its first sign
        s, e = start + shift[start], end + shift[start]
        last[at[:-1] + np.arange(len(size))] = self.start
        short = (size <= LONG)[shift[start]]
        order = np.argsort(np.where(short, offset, 255).astype(np.uint8), kind="stable")
        s, e, token, offset = s[order], e[order], token[order], offset[order]
        tokens_made = np.where(token == self.other, e - s, 1)
        n_short = int(short.sum())
        i = 0
        while i < n_short:
            j = int(np.searchsorted(offset[:n_short], offset[i], "right"))
            own = np.flatnonzero(last[s[i:j]] >= 0) + i
            own = own[self.may_follow(last[s[own]], token[own])]
            last[e[own]], came[e[own]], made[e[own]] = token[own], s[own], made[s[own]] + tokens_made[own]
            i = j
        if n_short < len(s):
            rest = np.argsort(e[n_short:], kind="stable") + n_short
            memo: dict[tuple[int, int], bool] = {}
            for a, b, t, m in zip(s[rest].tolist(), e[rest].tolist(), token[rest].tolist(), tokens_made[rest].tolist(), strict=True):
                before = int(last[a])
                if before < 0:
                    continue
                fits = memo.get((before, t))
                if fits is None:
                    fits = memo[before, t] = bool(self.may_follow(np.array([before]), np.array([t]))[0])
                if fits:
                    last[b], came[b], made[b] = t, a, made[a] + m
        stop = at[1:] + np.arange(len(size))
        out_at = np.r_[0, np.cumsum(made[stop])]
        out = np.zeros(out_at[-1], np.int32)
        base = at[:-1] + np.arange(len(size))
        here, segment = stop.copy(), np.arange(len(size))
        while len(here):
            live = here > base[segment]
            here, segment = here[live], segment[live]
            to = out_at[segment] + made[came[here]]
            plain = last[here] != self.other
            out[to[plain]] = last[here[plain]]
            for h, g, o in zip(here[~plain], segment[~plain], to[~plain], strict=True):
                spelled = text[came[h] - g : h - g]
                out[o : o + len(spelled)] = self.bytes_of[spelled]
            here = came[here]
        return out, out_at

    def distinct(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the different segments in ascending order, a place of each, and every segment's number among them."""
        keys, first, back = np.unique(span_hashes(raw, starts, ends), return_index=True, return_inverse=True)
        size = ends - starts
        if not _same(raw, starts, size, raw, starts[first[back]], size[first[back]]).all():  # one hash of several segments
            numbers: dict[bytes, int] = {}
            back = np.array([numbers.setdefault(raw[a:b].tobytes(), len(numbers)) for a, b in zip(starts, ends, strict=True)])
            first = np.unique(back, return_index=True)[1]
            keys = np.arange(len(first), dtype=np.uint64)
            self.forget()
        return keys, first, back

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a string column in turn, and the n + 1 offsets of theirs."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = pc.replace_substring(pc.fill_null(column, ""), BLANK, " ")
        column = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(" ", column, ""))
        raw, at = flat_bytes(column)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        blank = raw == 32
        cut = np.zeros(len(raw), bool)
        cut[1:] = blank[1:] & ~blank[:-1]
        cut[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], len(raw)]
        distinct, first, back = self.distinct(raw, starts, ends)
        if len(self.seen) > KNOWN:
            self.forget()
        spot = np.minimum(np.searchsorted(self.seen, distinct), max(0, len(self.seen) - 1))
        fresh = self.seen[spot] != distinct if len(self.seen) else np.ones(len(distinct), bool)
        known = spot[~fresh]
        if not _same(raw, starts[first[~fresh]], (ends - starts)[first[~fresh]], self.spelled, self.spelled_at[known], self.spelled_n[known]).all():
            self.forget()  # two segments of one hash: the new one takes its place
            fresh[:] = True
        size = (ends - starts)[first[fresh]]
        seg_at = np.r_[0, np.cumsum(size)]
        take = np.arange(seg_at[-1]) - np.repeat(seg_at[:-1], size) + np.repeat(starts[first[fresh]], size)
        text, parts, made = raw[take], [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        i = 0
        while i < len(size):  # bounded chunks: matching needs some hundred bytes for each byte of text
            j = max(i + 1, int(np.searchsorted(seg_at, seg_at[i] + CHUNK, "right")) - 1)
            own, own_at = self.encode_segments(text[seg_at[i] : seg_at[j]], seg_at[i : j + 1] - seg_at[i])
            parts.append(own)
            made.append(own_at[1:] + made[-1][-1])
            i = j
        ids, id_at = np.concatenate(parts), np.concatenate(made)
        place = np.searchsorted(self.seen, distinct[fresh])
        self.seen = np.insert(self.seen, place, distinct[fresh])
        self.seen_at, self.seen_n = np.insert(self.seen_at, place, id_at[:-1] + len(self.seen_ids)), np.insert(self.seen_n, place, np.diff(id_at))
        self.spelled_at, self.spelled_n = np.insert(self.spelled_at, place, seg_at[:-1] + len(self.spelled)), np.insert(self.spelled_n, place, size)
        self.seen_ids, self.spelled = np.r_[self.seen_ids, ids], np.r_[self.spelled, text]
        spot = np.searchsorted(self.seen, distinct)[back]
        count = self.seen_n[spot]
        flat = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.seen_at[spot], count)
        return self.seen_ids[flat], np.r_[0, np.cumsum(count)][np.searchsorted(starts, at)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of rows of ids; bytes that make no sign become U+FFFD."""
        size = np.diff(self.raw_at)[ids]
        where = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.raw_at[:-1][ids], size)
        data = self.raw[where].tobytes()
        ends = np.r_[0, np.cumsum(size)][at]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return [t[1:] if t.startswith(" ") else t for t in texts]


def _same(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """Of pairs of spans of a and b: whether they hold the same bytes."""
    same = a_size == b_size
    size = np.where(same, a_size, 0)
    ends = np.cumsum(size)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    differ = np.flatnonzero(a[inside + np.repeat(a_at, size)] != b[inside + np.repeat(b_at, size)])
    same[np.searchsorted(ends, differ, "right")] = False
    return same


def load(path: str = MODEL) -> bytes:
    with open(path, "rb") as file:
        return file.read()


_HELD: dict[int, Model] = {}


def _model(data: bytes) -> Model:
    """The model of these bytes, built once a process."""
    key = hash(data)
    if key not in _HELD:
        _HELD[key] = Model(data)
    return _HELD[key]


def tokenize(docs: DataFrame, model: str = MODEL, decoded: bool = False) -> DataFrame:
    """docs with ids and n_tokens, and decoded (the text of the ids) where asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(load(model))
    own = ("ids", "n_tokens", "decoded")
    kept = docs.select(*[f"`{c}`" for c in others(docs.columns, own)])
    added = [StructField("ids", ArrayType(IntegerType())), *([StructField("decoded", StringType())] if decoded else [])]

    def run(batches):
        import pyarrow as pa

        pieces = _model(sent.value)
        for batch in small_batches(batches, "text", 2 << 20):
            ids, at = pieces.encode(batch.column(batch.schema.get_field_index("text")))
            more = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]
            if decoded:
                more.append(pa.array(pieces.decode(ids, at), pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *(f.name for f in added)])

    done = kept.mapInArrow(run, StructType([*kept.schema.fields, *added]))
    return done.withColumn("n_tokens", F.size("ids").cast("bigint"))


def op8_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    back = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), BLANK, " ")
    return tokenize(docs, decoded=True).select("doc_id", "n_tokens", "ids", back.alias("round_trip"))
