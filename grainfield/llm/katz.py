r"""Katz backoff scoring of whole texts with an n-gram model learned from the corpus.

    P1(w)      = d1(c) c / N                      for words of the training texts; what is left is the unknown word's
    Pk(w | h)  = dk(c) c / c(h)                   if (h, w) was seen c > 0 times, h being the k - 1 words before w
               = a(h) Pk-1(w | h')                else, h' being h without its first word; Pk-1(w | h') if h was never seen
    a(h)       = (1 - sum of Pk(w | h) over seen w) / (1 - sum of Pk-1(w | h') over seen w)

A text is scored with Pn, n = ``Settings.order``; marks stand for the words before its first one. dk(c) is the Good-Turing discount
of Katz for c <= K, and m / (m + 1) with m = N or c(h) beyond; so every history has something left, and all distributions
sum to exactly 1. Where the counts of counts do not give all discounts in (0, 1), they are smoothed to a line of
log n(r) over log r first, as in simple Good-Turing. Only a line that falls no faster than 1 / r, or fewer than two
counts to lay it through, leaves absolute discounting.

How it runs. Texts are cut into blocks of about ``Settings.block`` bytes, written once. A block sends its distinct words with
training counts to the words' partitions, which answer with corpus counts and ids. It then sends its (n-gram,
document) entries, packed in columns, to a partition of the last word before w. All histories of any length that end in
that word meet there, and so do the n-grams of all lengths that follow them: the n-gram tables of a partition are made
and evaluated recursively, down to one-word histories. Each entry becomes a sum by document: the log of counts, and how many have each
count that is to be discounted. When all counts of counts are known, the backoff weights of the histories that need them
come from the written tables, and the sums meet in their blocks.

A history of more than a share of all tokens is hot: it would be more than a task's work. Before the entries are sent, blocks ask
for the counts of n-grams with hot histories, which are dealt by all their words. Entries whose one-word history is hot
are dealt by two words, those whose two-word history is hot by three, and so on, and carry the counts that their partition
cannot see. The sums of hot histories are an aggregate that passes through the driver and reaches every task: some hundred bytes each, and up to
1 / ``Settings.share`` of them for each partition and level, a ten-thousandth of the text at most. This is not bounded: it grows with the input.
Numbers of partitions follow from the number of tokens, so a task's work does not grow with the input.

Nulls and odd cases: null and empty texts have the end token only. A null id is scored and not learned from.
Repeated rows count each. Without training texts all words are unknown with probability 1. Empty tables give empty results. Other
columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, crc_mod, hash_parts, mix64, pack, remove, scratch_path, steps, stored, unpack

#: Largest discounted count.
K = 5
_END = np.uint64(0x2545F4914F6CDD1D)
UNKNOWN, BEGIN, FIRST = 0, 1, 2


@dataclass(frozen=True)
class Settings:
    """order: words of an n-gram, 2 or more; block: bytes of text in a block; tokens: of a partition, on average; share: a history
    of more than this share of a partition's tokens is hot, if it has ``least`` tokens; rounds: in which entries are sent, each to its share
    of the partitions, so that no more of them are on disk at once."""

    order: int = 3
    block: int = 1 << 22
    tokens: int = 1 << 20
    share: float = 0.25
    least: int = 1000
    rounds: int = 2


def smoothed(c: np.ndarray) -> np.ndarray:
    """n(1..K+1) on a line of log n(r) over log r, each count shared with the gap around it; zeros where there is no line."""
    r = np.flatnonzero(c) + 1
    if len(r) < 2:
        return np.zeros(len(c))
    gap = (np.append(r[1:], 2 * r[-1] - r[-2]) - np.append(0, r[:-1])) / 2
    slope, level = np.polyfit(np.log(r), np.log(c[r - 1] / gap), 1)
    return np.exp(level + slope * np.log(np.arange(1, len(c) + 1)))


def discounts(n: list[int]) -> np.ndarray:
    """d(1..K) from the counts of counts n(1..K+1)."""
    r, c = np.arange(1, K + 1), np.array(n[: K + 1], np.float64)
    for m in (c, smoothed(c)):
        if (m > 0).all():
            a = (K + 1) * m[K] / m[0]
            d = ((r + 1) * m[1:] / (r * m[:-1]) - a) / (1 - a) if a != 1 else r * 0.0
            if ((d > 0) & (d < 1)).all():
                return d
    cut = min(0.9, max(0.1, c[0] / (c[0] + 2 * c[1]) if c[0] else 0.5))
    return 1 - cut / r


class Unigrams:
    """P(w) of a word by its training count; of the unknown word for 0."""

    def __init__(self, total: int, counts_of_counts: list[int]):
        self.total, n = total, np.array(counts_of_counts[:K], np.float64)
        self.d = discounts(counts_of_counts)
        low = (n * np.arange(1, K + 1)).sum()
        self.unknown = (((1 - self.d) * np.arange(1, K + 1) * n).sum() + (total - low) / (total + 1)) / total if total else 1.0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        if not self.total:
            return np.ones(len(c))
        p = c / (self.total + 1)
        p[c == 0] = self.unknown
        for r in range(1, K + 1):
            p[c == r] = self.d[r - 1] * r / self.total
        return p


@dataclass(frozen=True)
class Corpus:
    """What all tasks know: tokens and distinct words of the training texts, their number, P1, the count above which a history is
    hot, partitions, and the order."""

    total: int
    distinct: int
    texts: int
    unigrams: Unigrams
    hot: float
    parts: int
    order: int


_TYPES = {"kind": pa.int32(), "block": pa.string(), "p": pa.int32(), "level": pa.int32(), "doc_ids": pa.list_(pa.int64()), "train": pa.list_(pa.bool_()), "held": pa.list_(pa.bool_()), "cols": pa.list_(pa.binary()), "blocks": pa.list_(pa.string()), "n": pa.list_(pa.int64()), "real": pa.list_(pa.float64())}
_SQL = {"kind": "int", "block": "string", "p": "int", "level": "int", "doc_ids": "array<long>", "train": "array<boolean>", "held": "array<boolean>", "cols": "array<binary>", "blocks": "array<string>", "n": "array<long>", "real": "array<double>"}
_BLOCK = ["kind", "block", "doc_ids", "train", "held", "cols", "n"]
_REQUEST = ["block", "p", "cols"]
_ANSWER = ["kind", "block", "p", "level", "cols", "n", "real"]
_MOVED = ["kind", "block", "p", "level", "doc_ids", "held", "cols", "blocks", "n", "real"]


def _table(rows: list[dict], names: list[str]) -> pa.Table:
    return pa.table([pa.array([r.get(c) for r in rows], _TYPES[c]) for c in names], names=names)


def _batch(rows: list[dict], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], _TYPES[c]) for c in names], names=names)


def _sql(names: list[str]) -> str:
    return ", ".join(f"{k} {_SQL[k]}" for k in names)


def _mask(column: pa.Array) -> np.ndarray:
    return np.asarray(column.fill_null(False).to_numpy(zero_copy_only=False), bool)


def _grouped(keys: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin, in columns of equal length that are sorted together."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _sorted(keys: list[np.ndarray]) -> np.ndarray:
    """Order of rows by whole-number columns that are not negative, the first one most; columns go into one number as far as they fit."""
    packed: list[np.ndarray] = []
    room = 1
    for k in reversed(keys):
        size = int(k.max(initial=0)) + 1
        if packed and room * size < 1 << 63:
            packed[-1] = packed[-1] + k.astype(np.int64) * room
            room *= size
        else:
            packed.append(k.astype(np.int64))
            room = size
    return np.argsort(packed[0]) if len(packed) == 1 else np.lexsort(packed)


def _dealt(p: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by partition that keeps their order within, and bounds of the partitions that have rows (with their numbers)."""
    order = np.argsort(p.astype(np.uint16) if n < 1 << 16 else p, kind="stable")
    own = p[order]
    start = np.flatnonzero(_grouped([own])) if len(own) else np.zeros(0, np.int64)
    return order, np.stack([own[start], start, np.append(start[1:], len(own))], 1) if len(own) else np.zeros((0, 3), np.int64)


def _hashed(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1))
    return h


def _block_rows(size: int):
    """Rows of blocks. Kind 0: documents, tokens as numbers into the block's distinct words, tokens of each document; n: tokens, training
    texts. Kind 1: the distinct words' hashes, ascending, and training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in steps(batch.column(3), size):
                w = Words(part, lower=True)
                tokens = np.full(len(w.hash) + len(part), _END, np.uint64)
                tokens[np.arange(len(w.hash)) + w.row] = w.hash
                u, inverse = np.unique(tokens, return_inverse=True)
                sizes = np.diff(w.first) + 1
                ids, train, held = (batch.column(i).slice(first, len(part)) for i in range(3))
                train, held = _mask(train), _mask(held)
                counts = np.bincount(inverse, np.repeat(train, sizes), len(u)).astype(np.int64)
                block = uuid.uuid4().hex  # of the copy of the block that gets written; nothing reads it before
                yield _batch(
                    [
                        {"kind": 0, "block": block, "doc_ids": ids.to_pylist(), "train": train.tolist(), "held": held.tolist(), "cols": [pack(inverse), pack(sizes)], "n": [len(tokens), int(train.sum())]},
                        {"kind": 1, "block": block, "cols": [pack(np.diff(u, prepend=np.uint64(0))), pack(counts)]},
                    ],
                    _BLOCK,
                )

    return run


def _requests(n: int):
    """A block's distinct words by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, cols in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                u, counts = np.cumsum(unpack(cols[0].as_py(), np.uint64)), unpack(cols[1].as_py())
                _, bounds = _dealt(hash_parts(u, n), n)
                rows = [{"block": block, "p": int(p), "cols": [pack(np.diff(u[a:b], prepend=np.uint64(0))), pack(counts[a:b])]} for p, a, b in bounds.tolist()]
                yield _batch(rows, _REQUEST)

    return run


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 2)[1 : K + 2].tolist()


def _answers(n: int):
    """Merges the words of a partition. Kinds: 0 an answer to a block (ids, counts), 1 the unigram table, 2 counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        p = table.column("p")[0].as_py()
        blocks = table.column("block").to_pylist()
        words = [np.cumsum(unpack(x[0].as_py(), np.uint64)) for x in table.column("cols")]
        counts = np.concatenate([unpack(x[1].as_py()) for x in table.column("cols")])
        u, inverse = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(inverse, counts).astype(np.int64)
        rank = np.empty(len(u), np.int64)
        order = np.argsort(-total, kind="stable")
        rank[order] = np.arange(len(u))
        ids = np.where(total > 0, FIRST + rank * n + p, UNKNOWN)
        ends = np.cumsum([len(w) for w in words])
        rows = [{"kind": 0, "block": b, "p": p, "level": 1, "cols": [pack(ids[inverse[e - len(w) : e]]), pack(total[inverse[e - len(w) : e]])]} for b, w, e in zip(blocks, words, ends, strict=True)]
        seen = total > 0
        rows.append({"kind": 1, "p": p, "level": 1, "cols": [pack(u[seen]), pack(total[seen])]})
        rows.append({"kind": 2, "p": p, "level": 1, "n": [int(total.sum()), int(seen.sum()), *_counts_of_counts(total[seen])]})
        return _table(rows, _ANSWER)

    return run


class Block:
    """The tokens of a block, padded by order - 1 begin marks before each text, with what answers tell of them.

    word: ids; real: places of tokens; doc: index of each token's text; count[k]: corpus count of the k-gram that ends at each place, known where
    asked[k]; hot[k]: whether the history of k words before each place is hot.
    """

    def __init__(self, block: pa.Table, answers: pa.Table, c: Corpus, levels: int):
        """levels: up to which k-gram counts have been answered."""
        if block.num_rows != 1 or not answers.num_rows:
            raise ValueError("a block without its answers")
        self.c, m = c, c.order - 1
        self.train = np.array(block.column("train")[0].as_py(), bool)
        token, self.size = (unpack(x) for x in block.column("cols")[0].as_py())
        by = {}
        for level, p, cols in zip(answers.column("level").to_pylist(), answers.column("p").to_pylist(), answers.column("found"), strict=True):
            by.setdefault(level, []).append((p, cols))
        ids, counts = (np.concatenate([unpack(cols[i].as_py()) for _, cols in sorted(by[1], key=lambda r: r[0])]) for i in (0, 1))
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        self.real = np.arange(len(token)) + (self.doc + 1) * m
        self.word = np.full(len(token) + m * len(self.size), BEGIN, np.int64)
        self.word[self.real] = ids[token]
        none = np.full(len(self.word), c.texts, np.int64)
        self.count, self.asked, self.hot = {1: none}, {1: np.ones(len(none), bool)}, {}
        self.count[1][self.real] = counts[token]
        for k in range(1, c.order):
            self.hot[k] = self.asked[k] & (self.count[k] > c.hot)
            self.hot[k][1:] = self.hot[k][:-1].copy()
            self.hot[k][0] = False
            if k + 1 < c.order:
                self.asked[k + 1] = self.hot[k].copy()
                if k + 1 > levels:
                    break
                self.count[k + 1] = np.where(self.asked[k + 1], c.texts, 0)  # a run of begin marks occurs once a text
                got = {p: unpack(cols[0].as_py()) for p, cols in by.get(k + 1, ())}
                place, own, p, nth = self.asking(k + 1)
                value = np.zeros(len(own[0]), np.int64)
                order, bounds = _dealt(p, c.parts)
                for part, a, b in bounds.tolist():
                    value[order[a:b]] = got[part]
                self.count[k + 1][place] = value[nth]

    def past(self, place: np.ndarray, words: int) -> list[np.ndarray]:
        """The words before each place, the nearest first."""
        return [self.word[place - j] for j in range(1, words + 1)]

    def asking(self, k: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """Places whose k-gram has a hot history, these k-grams once each, in order, the partition of each, and the number of each place's."""
        place = self.real[self.asked[k][self.real]]
        grams = [*self.past(place, k - 1), self.word[place]]
        order = _sorted(grams) if len(place) else np.zeros(0, np.int64)
        own = [g[order] for g in grams]
        new = _grouped(own) if len(place) else np.zeros(0, bool)
        nth = np.empty(len(place), np.int64)
        nth[order] = np.cumsum(new) - 1
        own = [g[new] for g in own]
        return place, own, hash_parts(_hashed(own), self.c.parts), nth


def _hot_requests(k: int, c: Corpus):
    """The k-grams of a block that have hot histories, by partition: their words, training counts, and the counts that their backed-off
    probability is made of."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(block, answers, c, k - 1)
        place, own, p, nth = b.asking(k)
        train = np.zeros(len(b.word), bool)
        train[b.real] = np.repeat(b.train, b.size)
        counts = np.bincount(nth, train[place], len(p)).astype(np.int64)
        first = np.zeros(len(p), np.int64)
        first[nth] = place  # any place of each
        columns = [*own, counts, b.count[k - 1][first], b.count[k - 1][first - 1], b.count[k - 2][first - 1] if k > 2 else np.zeros(len(p), np.int64)]
        order, bounds = _dealt(p, c.parts)
        return _table([{"block": block.column("block")[0].as_py(), "p": int(i), "cols": [pack(x[order[s:e]]) for x in columns]} for i, s, e in bounds.tolist()], _REQUEST)

    return run


def _history_sums(level: int, hist: list[np.ndarray], count: np.ndarray, c_h: np.ndarray, parent: np.ndarray, parent_h: np.ndarray, c: Corpus) -> list[dict]:
    """What backoff weights are made of, for hot histories of seen k-grams: rows (level, words and count; real: sums)."""
    seen = np.flatnonzero(count > 0)
    if not len(seen):
        return []
    hist, count, c_h, parent, parent_h = [h[seen] for h in hist], count[seen], c_h[seen], parent[seen], parent_h[seen]
    order = _sorted(hist)
    start = np.flatnonzero(_grouped([h[order] for h in hist]))
    sums = np.stack([np.add.reduceat(x[order], start) for x in _parts(level, count, parent, parent_h, c)], 1)
    at = order[start]
    return [{"kind": 3, "level": level, "n": [*(int(h[i]) for h in hist), int(c_h[i]), int(parent_h[i])], "real": s} for i, s in zip(at.tolist(), sums.tolist(), strict=True)]


def _parts(level: int, count: np.ndarray, parent: np.ndarray, parent_h: np.ndarray, c: Corpus) -> list[np.ndarray]:
    """Of each seen k-gram: whether its count is r = 1..K; the probability it would back off to as far as it is known; and whether that is
    of a count r = 1..K yet to be discounted."""
    known = c.unigrams(parent) if level == 2 else np.where(parent > K, parent / (parent_h + 1.0), 0.0)
    low = [(parent == r).astype(np.float64) if level > 2 else np.zeros(len(count)) for r in range(1, K + 1)]
    return [*((count == r).astype(np.float64) for r in range(1, K + 1)), known, *low]


def _hot_answers(k: int, c: Corpus):
    """Merges the k-grams with hot histories of a partition. Kinds as in ``_answers``, and 3: sums by history."""

    def run(table: pa.Table) -> pa.Table:
        p = table.column("p")[0].as_py()
        cols = [[unpack(x[i].as_py()) for x in table.column("cols")] for i in range(k + 4)]
        ends = np.cumsum([len(x) for x in cols[0]])
        *grams, count, parent, c_h, parent_h = (np.concatenate(x) for x in cols)
        order = _sorted(grams)
        new = _grouped([g[order] for g in grams])
        start = np.flatnonzero(new)
        total = np.add.reduceat(count[order], start)
        nth = np.empty(len(order), np.int64)
        nth[order] = np.cumsum(new) - 1
        at = order[start]
        rows = [{"kind": 0, "block": b, "p": p, "level": k, "cols": [pack(total[nth[e - len(x) : e]])]} for b, x, e in zip(table.column("block").to_pylist(), cols[0], ends, strict=True)]
        seen = total > 0
        rows.append({"kind": 1, "p": p, "level": k, "cols": [*(pack(g[at][seen]) for g in grams), pack(total[seen])]})
        rows.append({"kind": 2, "p": p, "level": k, "n": _counts_of_counts(total[seen])})
        return _table(rows + _history_sums(k, [g[at] for g in grams[:-1]], total, c_h[at], parent[at], parent_h[at], c), _ANSWER)

    return run


def _entries(c: Corpus, turn: int, turns: int):
    """Makes of a block and its answers: kind 0, its documents with what needs no history (on the first turn), and kind 1, entries by
    partition, of the partitions whose turn it is: words before w
    from the nearest on, w, document and whether it is learned from, times, counts of the k-grams with hot histories, counts of hot
    histories; and a count of each distinct w."""

    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        b, n, m = Block(block, answers, c, c.order - 1), c.order, c.order - 1
        count, seen_h = b.count[1][b.real], b.count[1][b.real - 1] > 0
        base = np.bincount(b.doc, np.log10((count + 1) / (c.total + (c.distinct + 1))), len(b.size))
        known = np.bincount(b.doc[count > 0], minlength=len(b.size))
        own = np.bincount(b.doc[~seen_h], np.log10(c.unigrams(count[~seen_h])), len(b.size))
        place, doc = b.real[seen_h], b.doc[seen_h]
        past, w = b.past(place, m), b.word[place]
        order = _sorted([past[0], w, *past[1:], doc]) if len(place) else np.zeros(0, np.int64)
        place, doc, w, past = place[order], doc[order], w[order], [x[order] for x in past]
        new = _grouped([*past, w, doc]) if len(place) else np.zeros(0, bool)
        times = np.diff(np.append(np.flatnonzero(new), len(place)))
        place, doc, w, past = place[new], doc[new], w[new], [x[new] for x in past]
        hot = [b.hot[k][place] for k in range(1, n)]
        key, deep = _hashed(past[:1]) if len(place) else np.zeros(0, np.uint64), np.ones(len(place), bool)
        for k in range(1, n):
            deep = deep & hot[k - 1]
            if deep.any():
                key[deep] = _hashed([key[deep], (past[k] if k < m else w)[deep]])
        p = hash_parts(key, c.parts)
        if turns > 1:
            mine = np.flatnonzero(p % turns == turn)
            p, w, doc, times, place, past, hot = p[mine], w[mine], doc[mine], times[mine], place[mine], [x[mine] for x in past], [x[mine] for x in hot]
        columns = [*past, w, doc * 2 + b.train[doc], times]
        columns += [np.where(b.asked[k][place], b.count[k][place], 0) for k in range(2, n)]
        columns += [np.where(hot[k - 1], b.count[k][place - 1], 0) for k in range(1, n)]
        count = b.count[1][place]
        order, bounds = _dealt(p, c.parts)
        mark = block.column("block")[0].as_py()
        rows = [{"kind": 0, "block": mark, "p": zlib.crc32(mark.encode()) % c.parts, "doc_ids": block.column("doc_ids")[0].as_py(), "held": block.column("held")[0].as_py(), "cols": [pack(b.size), pack(known), pack(base), pack(own)]}][: turn == 0]
        rows += [{"kind": 1, "block": mark, "p": int(i), "cols": [*(pack(x[order[s:e]]) for x in columns), pack(_by_word(w[order[s:e]], count[order[s:e]]))]} for i, s, e in bounds.tolist()]
        return _table(rows, _MOVED)

    return run


def _by_word(w: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Counts of the distinct words in w, in the order of their ids."""
    return count[np.unique(w, return_index=True)[1]]


class Level:
    """The k-grams of a partition. of: number of each entry's k-gram; count; hist: number of each k-gram's history; c_h: of each history; sums: what
    its backoff weight is made of; words: of each history, nearest first; full: whether all of a history's k-grams are here."""

    def __init__(self, k: int, past: list[np.ndarray], w: np.ndarray, learned: np.ndarray, count_w: np.ndarray, told: np.ndarray | None, told_h: np.ndarray, below: Level | None, c: Corpus):
        new = _grouped([past[0], w, *past[1 : k - 1]])  # entries are sorted by these
        start = np.flatnonzero(new)
        self.of = np.cumsum(new) - 1
        self.count = np.add.reduceat(learned, start)
        hot = told_h[start] > c.hot
        if told is not None:
            self.count = np.where(hot, told[start], self.count)
        hist = [x[start] for x in past[: k - 1]]
        order = _sorted(hist)
        first = _grouped([h[order] for h in hist])
        self.hist = np.empty(len(start), np.int64)
        self.hist[order] = np.cumsum(first) - 1
        at = order[np.flatnonzero(first)]
        self.words, self.full = [h[at] for h in hist], ~hot[at]
        self.c_h = np.where(hot[at], told_h[start][at], np.bincount(self.hist, self.count, len(at)).astype(np.int64))
        if below is None:
            parent, parent_h = count_w[start], np.zeros(len(start), np.int64)
        else:
            parent = below.count[below.of[start]]
            parent_h = below.c_h[below.hist[below.of[start]]]
        seen = self.count > 0
        self.parent_h = parent_h[at]
        parts = _parts(k, self.count, parent, parent_h, c)
        self.sums = np.stack([np.bincount(self.hist[seen], x[seen], len(at)) for x in parts], 1)
        whole = self.full[self.hist] & seen
        self.counts_of_counts = _counts_of_counts(self.count[whole | (seen & (k == c.order))])
        self.hot_sums = _history_sums(k, hist, np.where(hot, self.count, 0), self.c_h[self.hist], parent, parent_h, c) if k == c.order and hot.any() else []


def _counted(c: Corpus):
    """Makes the n-gram tables of a partition and the sums of its entries. Kinds: 0 documents (passed on), 1 sums by document of a block, 2 counts of
    counts, 3 sums of hot histories, 4 what waits for backoff weights."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        rows = table.filter(pa.array(kind == 0)).select(_MOVED).to_pylist()
        part, n, m = table.column("p")[0].as_py(), c.order, c.order - 1
        mine = table.filter(pa.array(kind == 1))
        del table
        if not mine.num_rows:
            return _table(rows, _MOVED)
        blocks = mine.column("block").to_pylist()
        sizes = [len(unpack(row[0].as_py())) for row in mine.column("cols")]
        # one column after another, in 32 bits where they do: no second copy of all entries
        cols = [_narrow(np.concatenate([unpack(row[i].as_py()) for row in mine.column("cols")])) for i in range(m + 3 + (n - 2) + m)]
        ends = np.cumsum(sizes)
        each = [unpack(row[m + 3 + n - 2 + m].as_py())[np.unique(cols[m][e - x : e], return_inverse=True)[1]] for row, e, x in zip(mine.column("cols"), ends, sizes, strict=True)]
        cols.insert(m + 3, _narrow(np.concatenate(each)))
        del each
        cols.append(np.repeat(np.arange(len(blocks), dtype=np.int32), sizes))
        del mine
        order = _sorted([cols[0], cols[m], *cols[1:m]])
        for i in range(len(cols)):
            cols[i] = cols[i][order]
        del order
        past, (w, d, times, count_w) = cols[:m], cols[m : m + 4]
        told, told_h, b = dict(zip(range(2, n), cols[m + 4 :], strict=False)), dict(zip(range(2, n + 1), cols[m + 4 + n - 2 :], strict=False)), cols[-1]
        learned = (times * (d & 1)).astype(np.int64)
        d = d >> 1
        levels: dict[int, Level] = {}
        for k in range(2, n + 1):
            levels[k] = v = Level(k, past, w, learned, count_w, told.get(k), told_h[k], levels.get(k - 1), c)
            rows.append({"kind": 2, "p": part, "level": k, "n": v.counts_of_counts})
            rows += [r | {"p": part} for r in v.hot_sums]
        # of each entry: log of what it is resolved to, by the longest k-gram seen, and what it waits for
        width = int(d.max()) + 1
        code, cells = b.astype(np.int64) * width + d, len(blocks) * width
        done = np.zeros(len(w), bool)
        total, often = np.zeros(cells), np.zeros((m * K, cells), np.int64)
        for k in range(n, 1, -1):
            v = levels[k]
            c_k = v.count[v.of]
            now = np.flatnonzero(~done & (c_k > 0))
            if len(now):
                own, c_h = c_k[now], v.c_h[v.hist[v.of[now]]]
                total += np.bincount(code[now], np.log10(own / (c_h + (own > K))) * times[now], cells)
                for r in range(1, K + 1):
                    often[(k - 2) * K + r - 1] = np.bincount(code[now], times[now] * (own == r), cells)
                done[now] = True
            wait = np.flatnonzero(~done & (v.c_h[v.hist[v.of]] > 0))
            if len(wait):
                used, index = np.unique(v.hist[v.of[wait]], return_inverse=True)
                rows.append({"kind": 4, "p": part, "level": k, "blocks": blocks, "cols": [*(pack(x[used]) for x in (*v.words, v.c_h, v.parent_h, v.full.astype(np.int64))), pack(v.sums[used].ravel()), *(pack(x) for x in (index, b[wait], d[wait], times[wait]))]})
        rest = np.flatnonzero(~done)
        total += np.bincount(code[rest], np.log10(c.unigrams(count_w[rest].astype(np.int64))) * times[rest], cells)
        present = np.flatnonzero(np.bincount(code, minlength=cells))
        bounds = np.searchsorted(present, np.arange(len(blocks) + 1) * width)
        for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            own = present[x:y]
            rows.append({"kind": 1, "block": blocks[i], "p": part, "cols": [pack(own - i * width), pack(total[own]), pack(often[:, own].ravel())]})
        return _table(rows, _MOVED)

    return run


def _narrow(a: np.ndarray) -> np.ndarray:
    return a.astype(np.int32) if a.max(initial=0) < 1 << 31 else a


def backoff(c_h: np.ndarray, parent_h: np.ndarray, sums: np.ndarray, d: np.ndarray, below: np.ndarray) -> np.ndarray:
    """a(h): what discounting leaves of a history, over what the words not seen after it hold of the shorter history's distribution."""
    r = np.arange(1, K + 1)
    low, covered, low_below = sums[:, :K], sums[:, K], sums[:, K + 1 :]
    lost = (low * r * (1 - d)).sum(1) + (c_h - (low * r).sum(1)) / (c_h + 1.0)
    covered = covered + (low_below * r * below).sum(1) / np.maximum(parent_h, 1)
    return lost / c_h / (1 - covered)


def _weighed(d: dict[int, np.ndarray], hot: dict[tuple, np.ndarray]):
    """Sums by document of log a(h) over the entries that wait for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level, cols, blocks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                words = [unpack(cols[i].as_py()) for i in range(level - 1)]
                c_h, parent_h, full = (unpack(cols[level - 1 + i].as_py()) for i in range(3))
                sums = unpack(cols[level + 2].as_py(), np.float64).reshape(-1, 2 * K + 1).copy()
                index, b, doc, times = (unpack(cols[level + 3 + i].as_py()) for i in range(4))
                for i in np.flatnonzero(full == 0):
                    sums[i] = hot[(level, *(int(x[i]) for x in words))]
                weight = np.log10(backoff(c_h, parent_h, sums, d[level], d[level - 1]))[index] * times
                width = int(doc.max()) + 1
                total = np.bincount(b * width + doc, weight, len(blocks) * width)
                present = np.unique(b * width + doc)
                at = np.searchsorted(present, np.arange(len(blocks) + 1) * width)
                rows = [{"block": blocks[i], "cols": [pack(present[x:y] - i * width), pack(total[present[x:y]])]} for i, (x, y) in enumerate(zip(at[:-1], at[1:], strict=True)) if y > x]
                yield _batch(rows, ["block", "cols"])

    return run


def _finished(d: dict[int, np.ndarray], c: Corpus):
    """One row a document of a block from its sums."""

    def run(docs: pa.Table, sums: pa.Table) -> pa.Table:
        ids, held = docs.column("doc_ids")[0].as_py(), docs.column("held")[0].as_py()
        size, known, base, score = (unpack(x, kind) for x, kind in zip(docs.column("cols")[0].as_py(), (np.int64, np.int64, np.float64, np.float64), strict=True))
        score = score.copy()
        logs = np.log10(np.concatenate([d[k] for k in range(2, c.order + 1)]))
        for cols in sums.column("sums"):
            at, part, *often = (x.as_py() for x in cols)
            own = unpack(part, np.float64)
            if often:
                own = own + logs @ unpack(often[0]).reshape(len(logs), -1)
            score[unpack(at)] += own
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held, pa.bool_()), "n_tokens": size, "n_known": known, "train_tokens": np.full(len(ids), c.total), "base_score": base, "score": score})

    return run


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _sum_of(tables: DataFrame) -> dict[int, list[int]]:
    """Sums of the kind 2 rows by level and place: a few numbers a level."""
    found = tables.where("kind = 2").select("level", F.posexplode("n")).groupBy("level", "pos").agg(F.sum("col").alias("n")).collect()
    out: dict[int, dict[int, int]] = {}
    for r in found:
        out.setdefault(r["level"], {})[r["pos"]] = int(r["n"])
    return {k: [v.get(i, 0) for i in range(max(v) + 1)] for k, v in out.items()}


def score(docs: DataFrame, train: Column, held: Column, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; learns from the rows for which train holds."""
    if settings.order < 2:
        raise ValueError(f"the order is at least 2, not {settings.order}")
    spark, n = docs.sparkSession, settings.order
    paths = {k: scratch_path(spark, f"katz-{k}") for k in ("blocks", "words", "sums", *(f"hot{k}" for k in range(2, n)))}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(held, F.lit(False)).alias("held"), F.col("text").cast("string").alias("text"))
    blocks = stored(rows.mapInArrow(_block_rows(settings.block), _sql(_BLOCK)), paths["blocks"], ("kind",))
    size = blocks.where("kind = 0").agg(F.sum(F.col("n")[0]).alias("tokens"), F.sum(F.col("n")[1]).alias("texts")).first()
    parts = max(1, -(-int(size["tokens"] or 0) // settings.tokens))
    asked = blocks.where("kind = 1").select("block", "cols").mapInArrow(_requests(parts), _sql(_REQUEST))
    told = [stored(asked.groupBy("p").applyInArrow(_answers(parts), _sql(_ANSWER)), paths["words"], ("kind",))]
    remove(spark, f"{paths['blocks']}/kind=1")
    total, distinct, *counts = _sum_of(told[0]).get(1, [0] * (K + 3))
    c = Corpus(total, distinct, int(size["texts"] or 0), Unigrams(total, counts), max(settings.least, settings.share * total / parts), parts, n)
    texts = blocks.where("kind = 0").select("block", "doc_ids", "train", "held", "cols")

    def with_answers(make, schema: str) -> DataFrame:
        # names of its own on each side: a projection above would take columns of one name from both
        own = reduce(DataFrame.union, [t.where("kind = 0").select(F.col("block").alias("to"), "p", "level", F.col("cols").alias("found")) for t in told])
        return texts.groupBy("block").cogroup(own.groupBy("to")).applyInArrow(make, schema)

    for k in range(2, n):
        asked = with_answers(_hot_requests(k, c), _sql(_REQUEST))
        told.append(stored(asked.groupBy("p").applyInArrow(_hot_answers(k, c), _sql(_ANSWER)), paths[f"hot{k}"], ("kind",)))
    turns = [stored(with_answers(_entries(c, i, settings.rounds), _sql(_MOVED)).groupBy("p").applyInArrow(_counted(c), _sql(_MOVED)), f"{paths['sums']}-{i}", ("kind",)) for i in range(settings.rounds)]
    tables = reduce(DataFrame.union, turns)
    remove(spark, paths["blocks"])
    for k in (1, *range(2, n)):
        remove(spark, f"{paths['words' if k == 1 else f'hot{k}']}/kind=0")
    known = [_sum_of(t) for t in (*told[1:], tables)]
    d = {1: c.unigrams.d} | {k: discounts([sum(x.get(k, [0] * (K + 1))[i] for x in known) for i in range(K + 1)]) for k in range(2, n + 1)}
    # hot histories of a level are at most total / hot: up to four for each partition, so they grow with the input
    hot = tables.where("kind = 3").select("level", "n", "real")
    for t in told[1:]:
        hot = hot.union(t.where("kind = 3").select("level", "n", "real"))
    sums = [F.sum(F.col("real")[i]).alias(f"s{i}") for i in range(2 * K + 1)]
    found = hot.groupBy("level", "n").agg(*sums).collect()
    shared = {(r["level"], *r["n"][:-2]): np.array([r[f"s{i}"] for i in range(2 * K + 1)]) for r in found}
    weighed = tables.where("kind = 4").select("level", "cols", "blocks").mapInArrow(_weighed(d, shared), _sql(["block", "cols"]))
    sums = tables.where("kind = 1").select("block", "cols").union(weighed).select(F.col("block").alias("to"), F.col("cols").alias("sums"))
    return tables.where("kind = 0").select("block", "doc_ids", "held", "cols").groupBy("block").cogroup(sums.groupBy("to")).applyInArrow(_finished(d, c), _RESULT)


def op6_katz(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents by trigrams; a seventh is held out."""
    fold = crc_mod(F.col("doc_id"), 7)
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold != 2, fold == 2)
