r"""Conversation structure repair: the cheapest edits that give alternating turns, found by dynamic programming over shared edit prefixes.

A conversation's rows are taken by turn (nulls first), then role and text. A row's first fault counts: blank (nothing but white space), duplicate
(role and text seen earlier), truncated (its last visible character ends no sentence). Edits: Keep (0), Rerole to user or assistant (3), Delete (4;
the only one for blank and duplicate rows), Insert an empty user or assistant turn (3); a truncated row that stays costs 3 more. What
is left must begin with a system turn or not, then alternate user and assistant and end with assistant, or be empty; roles
are told by their initials. Of all cheapest edit strings (initials D, I, K, R) the one that sorts first is the audit.

The state before each row is what the last turn left was: nothing, system, user or assistant. For each state the best edit
string is a node of a persistent tree: it links to the string that it extends, so prefixes are shared; it has its ancestors at distances 1, 2, 4,
... and a rolling hash of its whole string. Costs decide first. Of equal costs, two strings are compared at the end of their longest common
prefix, which a binary search over hashes of ancestors finds; what lies between there and the node that both share is compared
character by character, so a collision of hashes cannot decide. (A string is never the beginning of another with equal cost and state: edits from a
state lead to one state each.)

Long conversations are cut. Rows are dealt by ranges of (conversation, turn, role, text) and sorted; a conversation inside a partition is
repaired there, as it comes. One that touches a partition's edge or is longer than ``Settings.rows`` gives, for each piece, the best string from every state to
every state; pieces are joined in order by the same comparison, with whole pieces as edges of the tree. Only the digest of what is
kept needs a conversation's rows in one stream; it is fed row by row. So no task holds a conversation, but for its audit, one character an edit.
Equal rows travel as one with a count; earlier occurrences come from an aggregate, not from a window over a conversation.

Nulls and odd rows: null roles and texts are one space (a blank row); null conversation ids are one conversation. Turns may be null, repeat or have
gaps. ``times`` (optional) is how often a row stands there; 0 keeps its conversation in the result without the row. A
conversation without rows has zeros, an empty audit and the digest of nothing. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

# fixed values: costs of edits
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after a system turn, after a user turn, after an assistant turn. The state that an inserted or reroled turn leads to.
NEXT = (2, 2, 3, 2)
#: The state that a kept turn leads to, by its initial.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\x0b\x0c\r"
#: Rolling hashes are modulo a prime.
MOD, BASE = (1 << 61) - 1, 0x5F3759DF9E3779B
#: Conversations up to so many rows are looked up by their rows' initials and faults.
SHORT = 64


@dataclass(frozen=True)
class Settings:
    """rows, chars: of a piece of a long conversation."""

    rows: int = 4096
    chars: int = 1 << 22


def _hashes(text: str) -> list[int]:
    return list(accumulate(text, lambda h, c: (h * BASE + ord(c)) % MOD, initial=0))


class Path:
    """An edit string: another one and what follows it. up: its ancestors at distances 1, 2, 4, ...; size, hash: of the whole string."""

    __slots__ = ("up", "text", "size", "hash")

    def __init__(self, parent: Path | None = None, text: str = ""):
        self.up, self.text = [], text
        if parent is None:
            self.size = self.hash = 0
            return
        up, k = [parent], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up, self.size = up, parent.size + len(text)
        self.hash = (parent.hash * pow(BASE, len(text), MOD) + _hashes(text)[-1]) % MOD

    def above(self, size: int) -> tuple[Path, Path | None]:
        """The longest ancestor (or self) of at most that size, and the next below it."""
        if self.size <= size:
            return self, None
        at = self
        for k in range(len(at.up) - 1, -1, -1):
            if k < len(at.up) and at.up[k].size > size:
                at = at.up[k]
        return at.up[0], at

    def prefix(self, size: int) -> int:
        """Hash of the first characters."""
        at, below = self.above(size)
        rest = size - at.size
        return at.hash if not rest else (at.hash * pow(BASE, rest, MOD) + _hashes(below.text[:rest])[-1]) % MOD

    def between(self, start: int, end: int) -> str:
        """Characters from start on up to end."""
        at, below = self.above(end)
        parts = [below.text[: end - at.size]] if below else []
        while at.size > start:
            parts.append(at.text)
            at = at.up[0]
        return "".join(reversed(parts))[start - at.size :]

    def __str__(self) -> str:
        return self.between(0, self.size)


def _last(low: int, high: int, holds: Callable[[int], bool]) -> int:
    """The largest number from low to high for which it holds; it holds at low, and nowhere after it first does not."""
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if holds(mid) else (low, mid - 1)
    return low


def before(a: Path, b: Path) -> bool:
    """Whether a sorts before b."""
    most = min(a.size, b.size)
    common = _last(0, most, lambda n: a.prefix(n) == b.prefix(n))
    shared = a.above(_last(0, common, lambda n: a.above(n)[0] is b.above(n)[0]))[0].size
    x, y = a.between(shared, common), b.between(shared, common)
    if x != y:  # equal hashes of unequal strings
        common = shared + next(i for i, (p, q) in enumerate(zip(x, y)) if p != q)
    return a.between(common, min(common + 1, a.size)) < b.between(common, min(common + 1, b.size))


Best = list  # of (cost, path) or None by state


def _offer(best: Best, state: int, cost: int, parent: Path, text: str) -> None:
    """Takes a string for a state if it is better."""
    have = best[state]
    if have is None or cost < have[0]:
        best[state] = (cost, Path(parent, text))
    elif cost == have[0] and before(new := Path(parent, text), have[1]):
        best[state] = (cost, new)


def inserted(best: Best) -> Best:
    """With turns inserted where that is better; a second turn follows an inserted user turn only."""
    out = list(best)
    for state in (0, 1, 3):
        if best[state]:
            _offer(out, 2, best[state][0] + INSERT, best[state][1], "I")
    if out[2]:
        _offer(out, 3, out[2][0] + INSERT, out[2][1], "I")
    return out


def edited(best: Best, rows: str) -> Best:
    """After rows, two characters each: initial (another letter for all but s, u and a) and fault (D blank or duplicate, T truncated, - none)."""
    for i in range(0, len(rows), 2):
        kept, fault = KEPT.get(rows[i]), rows[i + 1]
        best, more = inserted(best), TRUNCATED if fault == "T" else 0
        out: Best = [None] * 4
        for state, have in enumerate(best):
            if have is None:
                continue
            cost, path = have
            if fault != "D":
                if kept and kept[state] is not None:
                    _offer(out, kept[state], cost + more, path, "K")
                _offer(out, NEXT[state], cost + REROLE + more, path, "R")
            _offer(out, state, cost + DELETE, path, "D")
        best = out
    return best


def ended(best: Best) -> tuple[int, str]:
    """The cost and audit of a whole conversation."""
    first, other = (inserted(best)[s] for s in (0, 3))
    if first is None or other is None:
        cost, path = first or other
    else:
        cost, path = other if other[0] < first[0] or other[0] == first[0] and before(other[1], first[1]) else first
    return cost, str(path)


def start(state: int = 0) -> Best:
    return [(0, Path()) if s == state else None for s in range(4)]


@lru_cache(maxsize=1 << 16)
def _short(rows: str) -> tuple[int, str]:
    return ended(edited(start(), rows))


def audit_of(rows: str) -> tuple[int, str]:
    return _short(rows) if len(rows) <= 2 * SHORT else ended(edited(start(), rows))


def joined(best: Best, costs: list, audits: list) -> Best:
    """best followed by a piece: costs and audits by 4 * state before + state after."""
    out: Best = [None] * 4
    for before_, have in enumerate(best):
        for after in range(4):
            if have and costs[4 * before_ + after] is not None:
                _offer(out, after, have[0] + costs[4 * before_ + after], have[1], audits[4 * before_ + after])
    return out


class Replay:
    """Applies an audit to rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _new(self) -> str:
        role = "assistant" if self.state == 2 else "user"
        self.state = NEXT[self.state]
        return role

    def inserts(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._new(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = KEPT[role[0]][self.state]
            yield role, text
        elif edit == "R":
            yield self._new(), text


class Digest:
    """SHA-256 of turns, one a line."""

    def __init__(self):
        self.sha, self.sep = hashlib.sha256(), ""

    def add(self, turns: Iterator[tuple[str, str]]) -> None:
        for role, text in turns:
            self.sha.update(f"{self.sep}{role}:{text}".encode())
            self.sep = "\n"


@dataclass
class Facts:
    """What a run of rows shows. low, high: least and greatest turn; distinct: turns; head, tail: initials of its first and last row."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    distinct: int = 0
    low: int | None = None
    high: int | None = None
    head: str | None = None
    tail: str | None = None

    def add(self, turn: int | None, initial: str, blank: bool, duplicates: int, truncated: bool, times: int) -> None:
        own = Facts(times if blank else 0, 0 if blank else duplicates, int(truncated), (times - 1) * (initial * 2 not in LEGAL), int(turn is not None), turn, turn, initial, initial)
        self.join(own)

    def join(self, other: Facts) -> None:
        """With what follows."""
        if other.head is None:
            return
        if self.head is None:
            self.__dict__.update(other.__dict__)
            return
        self.blank, self.duplicate, self.truncated = self.blank + other.blank, self.duplicate + other.duplicate, self.truncated + other.truncated
        self.illegal += other.illegal + (self.tail + other.head not in LEGAL)
        if other.low is not None:
            self.distinct += other.distinct - (self.high == other.low)
            self.low, self.high = other.low if self.low is None else self.low, other.high
        self.tail = other.tail

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, (1 << 63) - 1)


FACTS = "blank long, duplicate long, truncated long, illegal long, distinct long, low long, high long, head string, tail string"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PART = f"done boolean, part int, seq int, costs array<long>, audits array<string>, {FACTS}, {RESULT.replace('blank long, duplicate long, truncated long, illegal long, ', '')}"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in schema.split(", "))])


def _out(schema: str) -> tuple[Callable, Callable]:
    """add(row) and flush(): rows of dictionaries, as batches of a few thousand."""
    arrow, rows = _arrow(schema), []

    def flush() -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)
            rows.clear()

    def add(row: dict) -> Iterator[pa.RecordBatch]:
        rows.append(row)
        if len(rows) >= 2048:
            yield from flush()

    return add, flush


class _Piece:
    """Rows of a conversation that stand together."""

    def __init__(self, conv_id, whole: bool):
        self.conv_id, self.whole, self.seq = conv_id, whole, 0
        self.reset()

    def reset(self) -> None:
        self.facts, self.rows, self.turns, self.chars = Facts(), [], [], 0

    def add(self, turn, role: str, text: str, times: int, first: bool) -> None:
        seen = text.rstrip(SPACE)
        blank = not seen
        duplicates = times - bool(first)
        truncated = not blank and first and seen[-1] not in ".!?"
        initial = role[:1]
        self.facts.add(turn, initial, blank, duplicates, truncated, times)
        mark = initial if initial in KEPT else "x"
        self.rows.append((mark + ("D" if blank or not first else "T" if truncated else "-")) + (mark + "D") * (times - 1))
        self.turns.append((role, text, times))
        self.chars += len(role) + len(text) + 2 * times

    def finished(self) -> dict:
        cost, audit = audit_of("".join(self.rows))
        replay, digest = Replay(audit), Digest()
        for role, text, times in self.turns:
            for _ in range(times):
                digest.add(replay.row(role, text))
        digest.add(replay.inserts())
        f = self.facts
        return {"done": True, "conv_id": self.conv_id, "gaps": f.gaps, "cost": cost, "audit": audit, "repaired_sha256": digest.sha.hexdigest(), **f.__dict__}

    def piece(self, part: int) -> dict:
        rows = "".join(self.rows)
        ways = [edited(start(s), rows) for s in range(4)]
        flat = [w for way in ways for w in way]
        out = {"done": False, "conv_id": self.conv_id, "part": part, "seq": self.seq, "costs": [w and w[0] for w in flat], "audits": [w and str(w[1]) for w in flat], **self.facts.__dict__}
        self.seq += 1
        return out


def _pieces(s: Settings):
    """Finished conversations of a sorted partition, and pieces of those that are long or touch its edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece = TaskContext.get().partitionId(), None
        add, flush = _out(_PART)
        for batch in batches:
            for conv_id, turn, role, text, times, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece is None or piece.conv_id != conv_id:
                    if piece is not None:
                        yield from add(piece.finished() if piece.whole else piece.piece(part))
                    piece = _Piece(conv_id, piece is not None)
                if times:
                    piece.add(turn, role, text, times, first)
                if len(piece.rows) >= s.rows or piece.chars >= s.chars:
                    piece.whole = False
                    yield from add(piece.piece(part))
                    piece.reset()
        if piece is not None:
            yield from add(piece.piece(part))
        yield from flush()

    return run


_OPEN = f"conv_id long, cost long, audit string, gaps long, {FACTS}"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs and audits of conversations from their pieces, in order."""
    add, flush = _out(_OPEN)
    now: tuple | None = None

    def done() -> dict:
        conv_id, best, facts = now
        cost, audit = ended(best)
        return {"conv_id": conv_id, "cost": cost, "audit": audit, "gaps": facts.gaps, **facts.__dict__}

    for batch in batches:
        for r in batch.to_pylist():
            if now is None or now[0] != r["conv_id"]:
                if now is not None:
                    yield from add(done())
                now = (r["conv_id"], start(), Facts())
            now[2].join(Facts(**{k: r[k] for k in Facts.__dataclass_fields__}))
            now = (now[0], joined(now[1], r["costs"], r["audits"]), now[2])
    if now is not None:
        yield from add(done())
    yield from flush()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations: a row with the audit, then their rows in order."""
    add, flush = _out("conv_id long, repaired_sha256 string")
    now: tuple | None = None

    def done() -> dict:
        now[2].add(now[1].inserts())
        return {"conv_id": now[0], "repaired_sha256": now[2].sha.hexdigest()}

    for batch in batches:
        for conv_id, audit, role, text, times in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "times")), strict=True):
            if audit is not None:
                if now is not None:
                    yield from add(done())
                now = (conv_id, Replay(audit), Digest())
                continue
            for _ in range(times):
                now[2].add(now[1].row(role, text))
    if now is not None:
        yield from add(done())
    yield from flush()


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def repair(turns: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row a conversation: gaps in its turns, rows by fault, illegal neighbours, cost and audit of the cheapest edits, digest of what they leave."""
    times = F.col("times").cast("long") if "times" in turns.columns else F.lit(1).cast("long")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    own = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), times.alias("times"))
    rows = written(own.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times")), "turns")
    there = rows.where("times > 0")
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    again = there.groupBy(F.col("conv_id").alias("_c"), said.alias("_said")).agg(F.count("*").alias("_n"), F.min(F.struct("turn")).alias("_first")).where("_n > 1").drop("_n")
    own = rows.withColumn("_own", said).join(again, _same(F.col("conv_id"), F.col("_c")) & (F.col("_own") == F.col("_said")), "left")
    first = F.col("_first").isNull() | _same(F.col("turn"), F.col("_first.turn"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = own.select("conv_id", "turn", "role", "text", "times", first.alias("first")).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(dealt.mapInArrow(_pieces(settings), _PART), "repair-parts")
    pieces = parts.where("not done").select("conv_id", "part", "seq", "costs", "audits", *Facts.__dataclass_fields__)
    opened = written(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_joined, _OPEN), "repair-open")
    key = opened.select(F.col("conv_id").alias("_c"))
    theirs = there.join(key, _same(F.col("conv_id"), F.col("_c")), "left_semi").select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "times")
    heads = opened.select("conv_id", "audit", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("times"))
    fed = heads.union(theirs).repartition("conv_id").sortWithinPartitions(order[0], F.col("audit").asc_nulls_last(), *order[1:])
    digests = fed.mapInArrow(_digested, "_d long, repaired_sha256 string")
    names = [x.split(" ")[0] for x in RESULT.split(", ")]
    late = opened.join(digests, _same(F.col("conv_id"), F.col("_d"))).select(*names)
    return parts.where("done").select(*names).union(late)


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): rows dropped (times 0), emptied, stripped of full stops, doubled or given to the user by crc32 of conversation and turn."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text = F.when(how <= 1, "").when(how == 2, F.regexp_replace(or_space("text"), "[.!?]", "")).otherwise(or_space("text"))
    role = F.when(how == 4, "user").otherwise(or_space("role"))
    return turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(how == 0, 0).when(how == 3, 2).otherwise(1).cast("long").alias("times"))


def op13_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged, with the cheapest repair of each."""
    return repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


# crc32 bit by bit; costs to go from each row and state, last row first; then the least letter that stays on a cheapest way, first row first
ORACLE_SQL = r"""
WITH RECURSIVE k AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
h AS (SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(v.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda z: ascii(z)::BIGINT)),
  lambda p, q: list_reduce(list_prepend(xor(p, q), range(8)), lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1))))) % 20 AS h FROM conversations v JOIN k ON k.conv_id IS NOT DISTINCT FROM v.conv_id),
d AS (SELECT c, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE h <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM d),
f AS (SELECT *, left(role, 1) AS r, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd'
  WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
x AS (SELECT c, i, role, text, r, fault IN ('b', 'd') AS gone, CASE fault WHEN 't' THEN 3 ELSE 0 END AS t FROM f),
n AS (SELECT c, coalesce(max(i), 0) AS n FROM k LEFT JOIN x USING (c) GROUP BY c),
b AS (SELECT c, n AS i, [0, 6, 3, 0] AS g FROM n UNION ALL
  SELECT c, i, [least(h0, 3 + h2, 6 + h3), least(h1, 3 + h2, 6 + h3), least(h2, 3 + h3), least(h3, 3 + h2)] FROM (
    SELECT b.c, b.i - 1 AS i,
      least(4 + g[1], CASE WHEN gone THEN 1e9::BIGINT ELSE t + least(3 + g[3], CASE r WHEN 's' THEN g[2] WHEN 'u' THEN g[3] ELSE 1e9::BIGINT END) END) AS h0,
      least(4 + g[2], CASE WHEN gone THEN 1e9::BIGINT ELSE t + least(3 + g[3], CASE r WHEN 'u' THEN g[3] ELSE 1e9::BIGINT END) END) AS h1,
      least(4 + g[3], CASE WHEN gone THEN 1e9::BIGINT ELSE t + least(3 + g[4], CASE r WHEN 'a' THEN g[4] ELSE 1e9::BIGINT END) END) AS h2,
      least(4 + g[4], CASE WHEN gone THEN 1e9::BIGINT ELSE t + least(3 + g[3], CASE r WHEN 'u' THEN g[3] ELSE 1e9::BIGINT END) END) AS h3
    FROM b JOIN x ON x.c = b.c AND x.i = b.i)),
e AS (SELECT b.c, b.i, b.g, a.g AS a, x.role, x.text, x.r, x.gone, x.t FROM b LEFT JOIN b AS a ON a.c = b.c AND a.i = b.i + 1 LEFT JOIN x ON x.c = b.c AND x.i = b.i + 1),
w AS (SELECT c, 0::BIGINT AS i, 0 AS s, '' AS audit, [] ::VARCHAR[] AS kept, 0 AS step FROM n UNION ALL
  SELECT c, i + (edit <> 'I')::INT, CASE edit WHEN 'D' THEN s WHEN 'K' THEN CASE r WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE CASE s WHEN 2 THEN 3 ELSE 2 END END, audit || edit,
    CASE edit WHEN 'D' THEN kept WHEN 'K' THEN list_append(kept, role || ':' || text) ELSE list_append(kept, CASE s WHEN 2 THEN 'assistant:' ELSE 'user:' END || CASE edit WHEN 'R' THEN text ELSE '' END) END, step + 1
  FROM (SELECT w.*, e.role, e.text, e.r, CASE WHEN 4 + a[s + 1] = g[s + 1] THEN 'D' WHEN 3 + g[CASE s WHEN 2 THEN 4 ELSE 3 END] = g[s + 1] THEN 'I'
      WHEN NOT gone AND t + CASE WHEN r = 's' AND s = 0 THEN a[2] WHEN r = 'u' AND s <> 2 THEN a[3] WHEN r = 'a' AND s = 2 THEN a[4] END = g[s + 1] THEN 'K'
      WHEN NOT gone AND 3 + t + a[CASE s WHEN 2 THEN 4 ELSE 3 END] = g[s + 1] THEN 'R' END AS edit FROM w JOIN e ON e.c = w.c AND e.i = w.i) WHERE edit IS NOT NULL),
z AS (SELECT c, arg_max(audit, step) AS audit, arg_max(kept, step) AS kept FROM w GROUP BY c),
y AS (SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated FROM f GROUP BY c),
p AS (SELECT c, count(*) AS illegal FROM (SELECT c, r, lag(r) OVER (PARTITION BY c ORDER BY i) AS q FROM f) WHERE q IS NOT NULL AND q || r NOT IN ('su', 'ua', 'au') GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  g[1]::BIGINT AS cost, audit, sha256(array_to_string(kept, chr(10))) AS repaired_sha256
FROM k JOIN z USING (c) JOIN b ON b.c = k.c AND b.i = 0 LEFT JOIN y ON y.c = k.c LEFT JOIN p ON p.c = k.c
"""
