r"""Secret scans: sliding-window Shannon entropy by character class over candidate strings.

Base findings are three patterns, leftmost and non-overlapping each: ``assign`` (a secret's name, a sign, a value), ``access`` (access key
ids) and ``hex``. A finding is the whole match; those that are too short are dropped.

The entropy scan adds findings. For each character class its candidates are the maximal runs of its alphabet that are as long as its
window. A window slides over a run one character at a time: counts of its characters change by the one that leaves and the one that enters, and so
does the sum of c * log2(c), kept in whole numbers, so no rounding gathers however long a run is. A window whose entropy reaches the
class's bits, and which holds enough digits and letters of each case, is flagged; flagged windows that overlap or touch are one span. A span in
which the allow-list (placeholders, alphabets, heads of embedded images) finds something is suppressed, as is one inside a base finding or
inside a span of another class. Base findings are never suppressed.

Bytes of a batch are looked up at once for long runs, and texts for the names; only texts that have either are searched. Work is linear in the
text, and one text at most is held besides its batch.

Nulls and odd rows: a null text counts as empty and has no findings; every row, with a null or repeated id too, gives one row. Positions are
code points, ends exclusive. Whole texts are searched, however long. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, utf8

#: Words before a value, either case; each with the base findings' patterns written out as every search tool reads them.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _cases(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(_cases(w) for w in NAMES[:4]) + "|" + _cases("api") + "_?" + _cases("key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]+"
#: Base kinds: name, pattern, group whose length counts, least length.
BASE = (("assign", ASSIGN, 2, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24))
#: Digits after the point of c * log2(c), as bits.
POINT = 20


@dataclass(frozen=True)
class CharClass:
    """alphabet: as inside brackets of a pattern; window: characters; bits: least entropy of a window's characters; digits, upper,
    lower, letters: least number of each in a window."""

    name: str
    alphabet: str
    window: int
    bits: float
    digits: int = 0
    upper: int = 0
    lower: int = 0
    letters: int = 0

    @property
    def most(self) -> int:
        """The largest sum of c * log2(c) over a window's characters, in whole numbers, at which its entropy is at least bits."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * (1 << POINT))


@dataclass(frozen=True)
class Settings:
    """classes: in the order in which their spans are listed; allow: patterns that suppress a span in which they are found."""

    classes: tuple[CharClass, ...] = (
        CharClass("entropy_hex", "0-9A-Fa-f", 20, 2.9, digits=2, letters=2),
        CharClass("entropy_alnum", "0-9A-Za-z", 20, 3.6, digits=2, letters=4),
        CharClass("entropy_base64", "0-9A-Za-z+/_-", 24, 3.9, digits=2, upper=2, lower=2, letters=8),
    )
    allow: tuple[str, ...] = field(
        default=(
            "[Ee][Xx][Aa][Mm][Pp][Ll][Ee]|[Ss][Aa][Mm][Pp][Ll][Ee]|[Dd][Uu][Mm][Mm][Yy]|[Pp][Ll][Aa][Cc][Ee][Hh][Oo][Ll][Dd][Ee][Rr]|[Cc][Hh][Aa][Nn][Gg][Ee]_?[Mm][Ee]",
            "[Aa][Bb][Cc][Dd][Ee][Ff][Gg]|01234567|12345678|98765432|[Xx]{6}|0{8}",
            "iVBORw0KGgo|R0lGOD|/9j/4AA",
        )
    )


def weights(most: int) -> list[int]:
    """c * log2(c) in whole numbers for counts up to most."""
    return [0] + [round(c * math.log2(c) * (1 << POINT)) for c in range(1, most + 1)]


def flagged(run: str, cls: CharClass) -> list[tuple[int, int]]:
    """Spans of a run that flagged windows cover."""
    width, table, most = cls.window, weights(cls.window), cls.most
    counts, total, out = dict.fromkeys(run, 0), 0, []
    digits = upper = lower = 0
    for i, c in enumerate(run):
        if i >= width:
            gone = run[i - width]
            n = counts[gone]
            counts[gone] = n - 1
            total += table[n - 1] - table[n]
            digits, upper, lower = digits - gone.isdigit(), upper - gone.isupper(), lower - gone.islower()
        n = counts[c]
        counts[c] = n + 1
        total += table[n + 1] - table[n]
        digits, upper, lower = digits + c.isdigit(), upper + c.isupper(), lower + c.islower()
        if i >= width - 1 and total <= most and digits >= cls.digits and upper >= cls.upper and lower >= cls.lower and upper + lower >= cls.letters:
            start = i - width + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


class Scanner:
    """The patterns of some settings, compiled."""

    def __init__(self, s: Settings = Settings()):
        self.base = [(k, re.compile(p), g, n) for k, p, g, n in BASE]
        self.classes = [(c, re.compile(f"[{c.alphabet}]{{{c.window},}}")) for c in s.classes]
        self.allow = [re.compile(p) for p in s.allow]
        self.rank = {k: i for i, k in enumerate([*(b[0] for b in BASE), *(c.name for c in s.classes)])}
        #: Shorter runs of any alphabet hold no access key, no hex finding and no window.
        self.least = min(c.window for c in (*s.classes, CharClass("", "", 20, 0)))
        self.alphabet = np.zeros(256, bool)
        for byte in range(128):
            self.alphabet[byte] = any(re.fullmatch(f"[{c.alphabet}]", chr(byte)) for c in s.classes) or bool(re.fullmatch("[A-Z0-9a-f]", chr(byte)))

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) of a text's findings, by start, then kind."""
        base = [(k, *m.span()) for k, p, g, n in self.base for m in p.finditer(text) if m.end(g) - m.start(g) >= n]
        found = []
        for cls, pattern in self.classes:
            for m in pattern.finditer(text):
                found += [(cls.name, m.start() + a, m.start() + b) for a, b in flagged(m[0], cls)]
        found = [x for x in found if not any(p.search(text, x[1], x[2]) for p in self.allow)]
        return sorted(base + _outermost(found, base, self.rank), key=lambda x: (x[1], self.rank[x[0]]))

    def likely(self, texts: pa.Array) -> Iterator[int]:
        """Rows of a string array that have a run or a name; no other has a finding."""
        for first, part in steps(texts):
            data, off = utf8(part.cast(pa.large_string()))
            inside = np.concatenate([[False], self.alphabet[data], [False]])
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            start, end = edges[::2], edges[1::2]
            long = end - start >= self.least
            # a run that crosses the end of a text is taken as one: of all its rows, some may have none
            first_row, last_row = (np.searchsorted(off, x[long], "right") - 1 for x in (start, end - 1))
            rows = {i for a, b in zip(first_row.tolist(), last_row.tolist()) for i in range(a, b + 1)}
            for i, text in enumerate(part.to_pylist()):
                low = (text or "").lower()
                if i in rows or any(n in low for n in NAMES):
                    yield first + i


def _outermost(found: list, base: list, rank: dict[str, int]) -> list:
    """Spans that lie in no base finding and in no span of another class; of equal spans, that of the first class."""
    out, reach = [], -1
    kept = sorted(base, key=lambda x: x[1])
    at, held = 0, -1
    for x in sorted(found, key=lambda x: (x[1], -x[2], rank[x[0]])):
        while at < len(kept) and kept[at][1] <= x[1]:
            held = max(held, kept[at][2])
            at += 1
        if x[2] > held and x[2] > reach:
            out.append(x)
        reach = max(reach, x[2])
    return out


_FOUND = "doc_id long, spans array<struct<kind: string, start: int, end: int>>"


def find_secrets(docs: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans): the findings in every row's whole text, by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(settings)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            spans: list = [[]] * len(batch)
            for i in scanner.likely(batch.column(1)):
                spans[i] = [{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(batch.column(1)[i].as_py())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).mapInArrow(run, _FOUND)


def op11_secrets(spark, sf_dir: str) -> DataFrame:
    """Findings in all documents."""
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda x: x["kind"].isin([b[0] for b in BASE]))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *[count(b[0]) for b in BASE], F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def _oracle(s: Settings) -> str:
    """The same by SQL: matches between the pieces that they split a text into, windows as rows, islands of flagged ones."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    kinds = [(k, p, f"length(regexp_extract(s, {quoted(p)}, {g})) >= {n}") for k, p, g, n in BASE] + [(c.name, f"[{c.alphabet}]+", f"length(s) >= {c.window}") for c in s.classes]
    parts = " UNION ALL ".join(
        f"SELECT r, {i} AS kind, s, a, a + length(s) AS b FROM (SELECT r, s, sum(length(s) + length(g)) OVER (PARTITION BY r ORDER BY i)::BIGINT - length(s) AS a FROM "
        f"(SELECT r, unnest(f) AS s, unnest(string_split_regex(text, {quoted(p)})[:len(f)]) AS g, unnest(range(len(f))) AS i FROM (SELECT *, regexp_extract_all(text, {quoted(p)}, 0) AS f FROM d))) WHERE {keep}"
        for i, (_, p, keep) in enumerate(kinds)
    )
    few = lambda p, n: f"length(regexp_replace(w, '[^{p}]', '', 'g')) >= {n}"
    slides = " UNION ALL ".join(
        f"SELECT r, kind, a + o AS a, a + o + {c.window} AS b FROM (SELECT r, kind, a, o, substr(s, o + 1, {c.window}) AS w FROM (SELECT *, unnest(range(length(s) - {c.window - 1})) AS o FROM m WHERE kind = {i})) "
        f"WHERE list_sum(list_transform(map_values(list_aggregate(string_split(w, ''), 'histogram')), lambda c: {weights(c.window)[1:]}[c::BIGINT])) <= {c.most} AND {few('0-9', c.digits)} AND {few('A-Z', c.upper)} AND {few('a-z', c.lower)} AND {few('A-Za-z', c.letters)}"
        for i, c in enumerate(s.classes, len(BASE))
    )
    allowed = " OR ".join(f"regexp_matches(substr(text, a + 1, b - a), {quoted(p)})" for p in s.allow)
    names = [k for k, _, _ in kinds]
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({parts}),
w AS ({slides}),
i AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY r, kind ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM w),
j AS (SELECT *, sum(new) OVER (PARTITION BY r, kind ORDER BY a) AS island FROM i),
e AS (SELECT r, kind, min(a) AS a, max(b) AS b FROM j GROUP BY r, kind, island),
f AS (SELECT e.* FROM e JOIN d USING (r) WHERE NOT ({allowed})),
x AS (SELECT r, kind, a, b FROM m WHERE kind < {len(BASE)} UNION ALL
  SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.r = f.r AND m.kind < {len(BASE)} AND m.a <= f.a AND m.b >= f.b)
    AND NOT EXISTS (SELECT 1 FROM f AS g WHERE g.r = f.r AND g.a <= f.a AND g.b >= f.b AND g.kind <> f.kind AND (g.a < f.a OR g.b > f.b OR g.kind < f.kind))),
y AS (SELECT *, {names}[kind + 1] || ':' || a || ':' || b AS t FROM x)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(t, ',' ORDER BY a, kind) FILTER (kind < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg(t, ',' ORDER BY a, kind), '') AS spans
FROM d LEFT JOIN y USING (r) GROUP BY r, doc_id"""


ORACLE_SQL = _oracle(Settings())
