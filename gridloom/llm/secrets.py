"""Secret scans in DataFrame functions only: fixed patterns, then windowed entropy of candidate strings.

A candidate is a run of CANDIDATE characters that the allow-list does not let off whole (words, numbers, paths), less what a
fixed pattern found in it and less what the allow-list takes out of it (uuids, dates, placeholders, rules); what is left,
still long enough and not let off either, is judged as it stands.

Nulls in text count as empty texts and give no span; a null doc_id is kept. Texts and runs of any length are scanned
whole, in time that grows with their length. Ties: spans that start together are ordered by kind (assign, access, hex,
entropy). Repeated rows are scanned each on its own; an empty table gives an empty table. scan() passes the columns of
the input through and adds spans, base_spans and n_<kind>, which replace any of those names; redact() returns just the
input's columns, with another text and n_chars.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import let, others, running_sums

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
#: Runs that may hold a random secret, and what such a run is made of, in the order of its counters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: The same runs by patterns that give up at once inside a run too short, and at a letter that begins no keyword.
FROM_START = {HEX: f"(?<![0-9a-f]){HEX}", CANDIDATE: f"(?<![A-Za-z0-9+/_=-]){CANDIDATE}", ASSIGN: f"(?=[apstAPST]){ASSIGN}"}
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a character over a window of 20, by the class of the candidate's characters. No window has exactly these.
THRESHOLDS = {"hex": 2.905, "alnum": 3.605, "base64": 3.805}
#: What is no secret wherever it stands in a run, by its number of characters: uuids, dates, placeholders, rules.
TAKEN_OUT = {
    36: r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    11: r"(?i)placeholder",
    10: r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
    8: r"(?i)changeme|your_key",
    7: r"(?i)example|yourkey",
    6: r"(?i)sample",
    5: r"(?i)dummy",
    4: r"(?i)xxxx",
    3: r"\+{3}|/{3}|_{3}|={3}|-{3}",
}
#: A run is cut into parts at these. A part is odd if it is longer than SHORT and either BROKEN is found in it (five consonants
#: or four vowels in a row, a lone small letter between capitals, letters after digits, five digits after a letter) or over one
#: in COMMON of its characters are RARE letters. A run with fewer than ODD characters in odd parts is no secret: words, numbers,
#: paths, words joined by signs.
JOINTS = "[/_=+-]+"
SHORT = 3
BROKEN = "[b-df-hj-np-tv-xz]{5}|[B-DF-HJ-NP-TV-XZ]{5}|[aeiouy]{4}|[AEIOUY]{4}|[A-Z][a-z][A-Z]|^[a-z][A-Z]|[A-Z][a-z]$|[0-9][A-Za-z]|[A-Za-z][0-9]{5}"
RARE = "jkqvwxzJKQVWXZ"
COMMON = 6
ODD = 12
#: Characters of the chunks in which a text is cut once, so that a part of it is read without the text before it.
CHUNK = 1024
#: c * log2(c) in units of 2^-40, whole numbers that add up exactly.
_SCALE = 1 << 40
_BITS = [round(c * math.log2(c) * _SCALE) if c else 0 for c in range(WINDOW + 1)]
#: Counters of 5 bits in a long.
_PACKED = 12


def _positions(text: Column, pattern: str, keep) -> Column:
    """Array of (start, end, value) of all matches, leftmost and non-overlapping, that keep(match, group 2) holds for."""
    group = 2 if pattern == ASSIGN else 0
    pattern = FROM_START.get(pattern, pattern)
    length = lambda x: F.length(x).cast("bigint")
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")

    def located(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.zip_with(gaps, found, lambda g, m: length(F.coalesce(g, F.lit(""))) + length(F.coalesce(m["hit"], F.lit(""))))
        starts = F.zip_with(running_sums(steps), gaps, lambda at, g: at + length(g))
        spans = F.zip_with(starts, found, lambda at, m: F.struct(at.alias("start"), (at + length(m["hit"])).alias("end"), m["value"].alias("value")))
        return F.filter(F.slice(spans, 1, F.size(found)), lambda s: s["start"].isNotNull() & keep(s))

    def paired(hits: Column) -> Column:
        if group == 0:
            return F.transform(hits, lambda h: F.struct(h.alias("hit"), h.alias("value")))
        return F.zip_with(hits, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda h, v: F.struct(h.alias("hit"), v.alias("value")))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) == 0, empty).otherwise(let(paired(h), located)))


def _chosen(values: list[int], place: Column) -> Column:
    """The element of the constants at a place from 0."""
    return F.element_at(F.expr(f"array({', '.join(f'{v}L' for v in values)})"), place + 1)


def window_entropy(value: Column) -> Column:
    """Largest Shannon entropy, in bits, of any WINDOW characters of a string of SIGNS.

    Each sign has a counter of 5 bits in one of six longs, bits is the sum of c * log2(c) over the window's counts. A
    step changes the counts of the character that enters and of the one that leaves only.
    """
    parts = -(-len(SIGNS) // _PACKED)
    names = [f"c{k}" for k in range(parts)]
    places = [max(0, SIGNS.find(chr(c))) for c in range(128)]
    gain = [b - a for a, b in zip(_BITS[:-1], _BITS[1:], strict=True)]
    zero = F.lit(0).cast("bigint")

    def scan(signs: Column) -> Column:
        def count(acc: Column, sign: Column) -> Column:
            held = F.element_at(F.array(*[acc[n] for n in names]), sign["part"] + 1)
            return F.call_function("shiftright", held, sign["shift"]).bitwiseAND(F.lit(31)).cast("int")

        def moved(acc: Column, sign: Column, gone: Column | None, bits: Column) -> Column:
            """The state with sign counted, and gone no longer."""
            less = (lambda k: F.when(gone["part"] == k, gone["one"]).otherwise(zero)) if gone is not None else lambda k: zero
            counts = [(acc[n] + F.when(sign["part"] == k, sign["one"]).otherwise(zero) - less(k)).alias(n) for k, n in enumerate(names)]
            return F.struct(*counts, bits.alias("bits"), F.least(acc["best"], bits).alias("best"))

        def first(acc: Column, i: Column) -> Column:
            sign = F.element_at(signs, i)
            return moved(acc, sign, None, acc["bits"] + _chosen(gain, count(acc, sign)))

        def step(acc: Column, i: Column) -> Column:
            pair = F.struct(F.element_at(signs, i).alias("sign"), F.element_at(signs, i - WINDOW).alias("gone"))

            def slid(p: Column) -> Column:
                sign, gone = p["sign"], p["gone"]
                bits = acc["bits"] + _chosen(gain, count(acc, sign)) - _chosen(gain, count(acc, gone) - 1)
                return let(bits, lambda b: moved(acc, sign, gone, b))

            return let(pair, lambda p: F.when((p["sign"]["part"] == p["gone"]["part"]) & (p["sign"]["shift"] == p["gone"]["shift"]), acc).otherwise(slid(p)))

        def after(full: Column) -> Column:
            start = F.struct(*[full[n].alias(n) for n in names], full["bits"].alias("bits"), full["bits"].alias("best"))
            return F.when(F.size(signs) > WINDOW, F.aggregate(F.sequence(F.lit(WINDOW + 1), F.greatest(F.size(signs), F.lit(WINDOW + 1))), start, step, lambda acc: acc["best"])).otherwise(full["bits"])

        empty = F.struct(*[zero.alias(n) for n in names], zero.alias("bits"), zero.alias("best"))
        least = let(F.aggregate(F.sequence(F.lit(1), F.lit(WINDOW)), empty, first), after)
        return F.lit(math.log2(WINDOW)) - least / F.lit(float(_SCALE * WINDOW))

    table = F.expr("array(" + ", ".join(f"named_struct('part', {p // _PACKED}, 'shift', {p % _PACKED * 5}, 'one', {1 << p % _PACKED * 5}L)" for p in places) + ")")
    signs = let(table, lambda t: F.transform(F.filter(F.split(value, "", -1), lambda c: c != ""), lambda c: F.element_at(t, F.ascii(c) + 1)))
    return let(signs, lambda x: F.when(F.size(x) < WINDOW, F.lit(0.0)).otherwise(scan(x)))


def _odd(value: Column) -> Column:
    """Whether enough of a run is made of parts that do not look like words or numbers."""

    def odd(part: Column) -> Column:
        size = F.length(part)
        return (size > SHORT) & (part.rlike(BROKEN) | (F.length(F.regexp_replace(part, f"[^{RARE}]", "")) * COMMON > size))

    parts = F.filter(F.split(value, JOINTS, -1), odd)
    return F.aggregate(parts, F.lit(0), lambda n, part: n + F.length(part)) >= ODD


def _random(span: Column) -> Column:
    value = span["value"]
    threshold = F.when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), THRESHOLDS["hex"]).when(value.rlike("^[A-Za-z0-9]+$"), THRESHOLDS["alnum"]).otherwise(THRESHOLDS["base64"])
    return F.when(_odd(value), window_entropy(value) > threshold).otherwise(F.lit(False))


def _tagged(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _covered(text: Column, spans: Column, cover) -> Column:
    """text with cover(hidden length) in place of each span; overlapping spans (in order of their starts) count as one."""

    def merged(all_: Column) -> Column:
        ends = F.transform(all_, lambda s: s["end"])
        reached = running_sums(ends, lambda a, b: F.greatest(a, b))
        first = F.filter(F.zip_with(all_, reached, lambda s, e: F.struct(s["start"].alias("start"), e.alias("before"))), lambda s: s["start"] >= s["before"])
        return let(first, lambda f: F.zip_with(f, F.concat(F.transform(F.slice(f, 2, F.size(f)), lambda s: s["before"]), F.array(F.array_max(ends))), lambda s, e: F.struct(s["start"].alias("start"), e.alias("end"))))

    def built(chunks: Column, joined: Column) -> Column:
        def part(start: Column, end: Column) -> Column:
            first = F.floor(start / CHUNK)
            near = F.array_join(F.slice(chunks, (first + 1).cast("int"), (F.floor(end / CHUNK) - first + 1).cast("int")), "")
            return F.when(end > start, near.substr((start - first * CHUNK + 1).cast("int"), (end - start).cast("int"))).otherwise("")

        size = F.length(text).cast("bigint")
        ends = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(joined, lambda s: s["end"]))
        starts = F.concat(F.transform(joined, lambda s: s["start"]), F.array(size))
        gaps = F.zip_with(ends, starts, part)
        covers = F.concat(F.transform(joined, lambda s: cover(s["end"] - s["start"])), F.array(F.lit("")))
        return F.array_join(F.flatten(F.zip_with(gaps, covers, lambda g, c: F.array(g, c))), "")

    done = let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), lambda c: let(merged(spans), lambda j: built(c, j)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def _remains(run: Column) -> Column:
    """A run with blanks for what the allow-list takes out of it."""
    value = run
    for size, pattern in TAKEN_OUT.items():
        value = F.regexp_replace(value, pattern, " " * size)
    return value


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and spans (array of start, kind number, end, in order), base_spans likewise, n_assign, n_access, n_hex, n_entropy."""
    t = F.col("text")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    found = rows.select(
        "row",
        "text",
        _tagged(_positions(t, ASSIGN, lambda s: F.length(s["value"]) >= 6), 0).alias("assign"),
        F.when(t.contains("AKIA"), _tagged(_positions(t, ACCESS, lambda s: s["end"] - s["start"] >= 20), 1)).otherwise(none).alias("access"),
        _tagged(_positions(t, HEX, lambda s: F.lit(True)), 2).alias("hex"),
    )
    base = found.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    shown = _covered(t, F.col("base"), lambda n: F.repeat(F.lit(" "), n.cast("int")))
    base = base.withColumn("runs", let(shown, lambda x: _positions(x, CANDIDATE, lambda s: _odd(s["value"]))))
    pieces = F.transform("runs", lambda r: F.transform(let(_remains(r["value"]), lambda x: _positions(x, CANDIDATE, _random)), lambda p: F.struct((r["start"] + p["start"]).alias("start"), F.lit(3).alias("kind"), (r["start"] + p["end"]).alias("end"))))
    fresh = base.withColumn("fresh", F.flatten(pieces))
    own = ("spans", "base_spans", "n_assign", "n_access", "n_hex", "n_entropy")
    return fresh.select(
        *[F.col("row").getField(c).alias(c) for c in others(docs.columns, own)],
        F.array_sort(F.concat("base", "fresh")).alias("spans"),
        F.col("base").alias("base_spans"),
        *[F.size(c).cast("bigint").alias(n) for n, c in (("n_assign", "assign"), ("n_access", "access"), ("n_hex", "hex"), ("n_entropy", "fresh"))],
    )


def rendered(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span replaced by mark; overlapping spans make one mark. n_chars, where there is one, follows
    the text; all other columns stay, whatever their names."""
    rows = scan(docs.select(F.struct(*[f"`{c}`" for c in docs.columns]).alias("row"), "text"))
    found = F.size("spans") > 0
    clean = rows.select("row", F.when(found, _covered(F.col("text"), F.col("spans"), lambda n: F.lit(mark))).otherwise(F.col("text")).alias("text"), found.alias("found"))
    changed = {"text": F.col("text"), "n_chars": F.when(F.col("found"), F.length("text").cast("bigint")).otherwise(F.col("row").getField("n_chars"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return clean.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op3_secret_scans(spark, sf_dir: str) -> DataFrame:
    from gridloom.llm.common import read_table

    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(rendered(F.col("base_spans")), 256).alias("base_sha256"), rendered(F.col("spans")).alias("spans"), "n_entropy")


def _sql_hits(kind: int, pattern: str, group: int, keep: str, table: str = "d") -> str:
    """Rows (doc, kind, value, start, end) of one pattern in the texts of a table (r, text, off); keep is a condition on value, which is the hit's group."""
    quoted = pattern.replace("'", "''")
    return (
        f"SELECT r, {kind} AS kind, value, (off + s)::BIGINT AS s, (off + s + length(hit))::BIGINT AS e FROM (SELECT r, off, hits[k] AS hit, vals[k] AS value, list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0) AS s "
        f"FROM (SELECT r, off, hits, vals, gaps, unnest(range(1, len(hits) + 1)) AS k FROM (SELECT r, off, regexp_extract_all(text, '{quoted}', 0) AS hits, regexp_extract_all(text, '{quoted}', {group}) AS vals, regexp_split_to_array(text, '{quoted}') AS gaps FROM {table}))) WHERE {keep}"
    )


def oracle_sql() -> str:
    """The same spans in DuckDB's SQL."""
    bits = f"list_max(list_transform(range(1, length(value) - {WINDOW} + 2), lambda i: list_aggregate(string_split(value[i:i + {WINDOW - 1}], ''), 'entropy')))"
    bound = f"CASE WHEN regexp_matches(value, '^([0-9a-f]+|[0-9A-F]+)$') THEN {THRESHOLDS['hex']} WHEN regexp_matches(value, '^[A-Za-z0-9]+$') THEN {THRESHOLDS['alnum']} ELSE {THRESHOLDS['base64']} END"
    odd_part = f"length(p) > {SHORT} AND (regexp_matches(p, '{BROKEN}') OR length(regexp_replace(p, '[^{RARE}]', '', 'g')) * {COMMON} > length(p))"
    odd = f"coalesce(list_sum(list_transform(list_filter(regexp_split_to_array(value, '{JOINTS}'), lambda p: {odd_part}), lambda p: length(p))), 0) >= {ODD}"
    random = f"CASE WHEN {odd} THEN {bits} > {bound} ELSE false END"
    parts = " UNION ALL ".join([_sql_hits(0, ASSIGN, 2, "length(value) >= 6"), _sql_hits(1, ACCESS, 0, "length(value) >= 20"), _sql_hits(2, HEX, 0, "true")])
    names = "['assign', 'access', 'hex', 'entropy'][kind + 1]"
    remains = "value"
    for size, pattern in TAKEN_OUT.items():
        remains = f"regexp_replace({remains}, '{pattern}', '{' ' * size}', 'g')"
    return (
        f"WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, 0 AS off FROM documents), base AS MATERIALIZED ({parts}), "
        "hidden AS (SELECT DISTINCT r, unnest(range(s, e)) AS i FROM base), signs AS (SELECT r, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) - 1 AS i FROM d WHERE r IN (SELECT r FROM base)), "
        "shown AS MATERIALIZED (SELECT signs.r, string_agg(CASE WHEN hidden.i IS NULL THEN c ELSE ' ' END, '' ORDER BY signs.i) AS text, 0 AS off FROM signs LEFT JOIN hidden ON hidden.r = signs.r AND hidden.i = signs.i GROUP BY signs.r UNION ALL SELECT r, text, 0 FROM d WHERE r NOT IN (SELECT r FROM base)), "
        f"runs AS MATERIALIZED (SELECT r, s AS off, {remains} AS text FROM ({_sql_hits(3, CANDIDATE, 0, odd, 'shown')})), fresh AS MATERIALIZED (SELECT * FROM ({_sql_hits(3, CANDIDATE, 0, 'true', 'runs')}) WHERE {random}), every AS (SELECT * FROM base UNION ALL SELECT * FROM fresh), "
        f"told AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_entropy, string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS b, string_agg({names} || ':' || s || ':' || e, ',' ORDER BY s, kind) AS a FROM every GROUP BY r) "
        "SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans, coalesce(n_entropy, 0)::BIGINT AS n_entropy FROM d LEFT JOIN told ON d.r = told.r"
    )
