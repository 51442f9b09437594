"""Removal of long repeated word runs by compaction of a De Bruijn graph.

Nodes are sampled word k-mers ("anchors"), edges the word k-mers of varying length that lead from one anchor
of a text to the next. A place is an anchor if its k-mer has the smallest hash of some window around it, so
every window of ``window`` words has an anchor that its own words decide, and equal windows have equal ones.

1. Every text gives its anchors: hash of the k-mer, the anchor before it and the words between, and a hash of the two edges around it.
2. An aggregate by node keeps the repeated nodes (those in two documents or more) with the smallest document, and says whether a node
   branches: whether its occurrences differ in an edge. A node that does not branch has one edge to the node before it, and where that one does
   not branch either, all their documents walk it alike: the edges between such nodes are plain paths.
3. Joins compact these paths: each node takes over its predecessor's predecessor, so the way to the head of its path doubles each round, and
   has in the end the head and its distance from it in words. (No path is a circle: a circle is entered somewhere, and there it branches.) A join
   brings that to the occurrences, and an aggregate by document, path and where the path would begin makes one row of each walk, however long. In the
   texts, neighbouring windows on plain paths are one run; windows at branching nodes remain rows of their own.
4. Runs and windows carry their coordinates and a 96-bit hash of all their words. A last aggregate and join on it
   verifies them: a run goes only if the same words, read at its source, begin in a smaller document.

Nulls and odd cases: null and empty texts have no words and nothing is removed. A null id loses nothing and is no
source. Rows that share an id never remove from each other. Repeats inside one document stay. Texts shorter than
a window stay whole. Empty tables give empty results. Other columns pass through ``remove_repeats``; columns named ``_ss_*`` are
reserved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, mix64, scratch_folder, scratch_path, slide, steps, stored, written

#: Words of an anchor.
K = 16


class Anchors:
    """Anchors of a slice of texts. at: word positions, ascending; low: for each valid window start, its smallest k-mer hash."""

    def __init__(self, texts: pa.Array, window: int):
        self.words = w = Words(texts)
        self.width = window - K + 1
        self.grams = w.grams(K)
        if len(w.hash) < window:
            self.at = self.starts = np.zeros(0, np.int64)
            self.low = np.zeros(0, np.uint64)
            return
        low = np.where(w.same(window), slide(self.grams, self.width, np.minimum), np.uint64(0))
        pad = np.zeros(self.width - 1, np.uint64)
        self.at = np.flatnonzero((slide(np.concatenate([pad, low, pad]), self.width, np.maximum) == self.grams) & (self.grams != 0))
        self.starts = np.flatnonzero(w.same(window))
        self.low = low[self.starts]

    def firsts(self) -> np.ndarray:
        """Whether each anchor is its text's first."""
        row = self.words.row[self.at]
        first = np.ones(len(self.at), bool)
        first[1:] = row[1:] != row[:-1]
        return first

    def contexts(self) -> np.ndarray:
        """A hash of the two edges at each anchor; the ends of a text count as places of their own."""
        w, at, first = self.words, self.at, self.firsts()
        row = w.row[at]
        last = np.ones(len(at), bool)
        last[:-1] = first[1:]
        before = np.where(first, w.first[row], np.concatenate([[0], at[:-1]]))
        after = np.where(last, w.first[row + 1], np.concatenate([at[1:], [0]]) + K)
        run = w.runs(1)
        own = run(before, at + K) * np.uint64(0x9FB21C651E98DF25) + run(at, after)
        return mix64(own + first.astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + last.astype(np.uint64) * np.uint64(0xE220A8397B1DCDAF))

    def deciding(self) -> np.ndarray:
        """For each window start the index of its anchor: the first one with the window's smallest hash."""
        j = np.searchsorted(self.at, self.starts)
        own = self.grams[self.at]
        todo = np.flatnonzero(own[j] != self.low) if len(j) else j
        while len(todo):
            j[todo] += 1
            todo = todo[own[j[todo]] != self.low[todo]]
        return j


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, _ss_key, text): the key tells rows that share an id apart by their text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("_ss_key"), text.alias("text"))


def anchor_table(docs: DataFrame, window: int) -> DataFrame:
    """(node, context, before, gap, doc_id, _ss_key, pos) of every anchor of every text; before, gap: the anchor before it, if any, and how many
    words back it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in steps(batch.column(2)):
                a = Anchors(part, window)
                row = a.words.row[a.at]
                index = pa.array(row + first)
                pos = (a.at - a.words.first[row]).astype(np.int32)
                node, alone = a.grams[a.at].view(np.int64), a.firsts()
                before, gap = np.roll(node, 1), (a.at - np.roll(a.at, 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node), pa.array(a.contexts().view(np.int64)), pa.array(before, mask=alone), pa.array(gap, mask=alone), batch.column(0).take(index), batch.column(1).take(index), pa.array(pos)],
                    names=["node", "context", "before", "gap", "doc_id", "_ss_key", "pos"],
                )

    return _keyed(docs).where("doc_id is not null").mapInArrow(run, "node long, context long, before long, gap int, doc_id long, _ss_key long, pos int")


def repeated_nodes(anchors: DataFrame) -> DataFrame:
    """(node, source, branches, before, gap) of nodes in two documents or more; the source is the smallest document. Nodes that do not branch have
    the edge to the node before them."""
    found = anchors.groupBy("node").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("_ss_last"), F.min("context").alias("a"), F.max("context").alias("b"), F.min(F.struct("before", "gap")).alias("e"))
    branches = F.col("a") != F.col("b")
    return found.where(F.col("source") < F.col("_ss_last")).select("node", "source", branches.alias("branches"), *[F.when(~branches, F.col(f"e.{c}")).alias(c) for c in ("before", "gap")])


def plain_paths(nodes: DataFrame) -> DataFrame:
    """(node, head, along) of nodes that do not branch: the first node of their plain path, and how many words behind it they are.

    Rounds of joins; after each, a node has found its head or has gone twice as far. What it takes is the longest path's number of nodes, as bits.
    """
    plain = nodes.where("not branches").select("node", "before", "gap")
    known = plain.select(F.col("node").alias("before"), F.lit(True).alias("there"))
    now = plain.join(known, "before", "left").select("node", F.when(F.col("there"), F.col("before")).otherwise(F.col("node")).alias("head"), F.when(F.col("there"), F.col("gap")).otherwise(0).alias("along"), F.col("there").isNull().alias("done"))
    ended, going = [], written(now, "ss-paths")
    while True:
        ended.append(going.where("done").select("node", "head", "along"))
        if going.where("not done").isEmpty():
            return reduce(DataFrame.union, ended)
        # a node whose head has ended has ended too
        of_head = reduce(DataFrame.union, [x.withColumn("done", F.lit(True)) for x in ended]).union(going.where("not done").select("node", "head", "along", "done"))
        of_head = of_head.select(F.col("node").alias("head"), F.col("head").alias("next"), F.col("along").alias("more"), F.col("done").alias("over"))
        step = going.where("not done").select("node", "head", "along").join(of_head, "head")
        going = written(step.select("node", F.col("next").alias("head"), (F.col("along") + F.col("more")).alias("along"), F.col("over").alias("done")), "ss-paths")


def walks(anchors: DataFrame, nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """(doc_id, _ss_key, marks): of each document with repeated nodes, its walks along plain paths and its branching nodes.

    A mark is the first place, then the words up to the last place (30 bits), whether a smaller document has it, and whether it is a branching node.
    """
    placed = written(nodes.join(paths, "node", "left").select("node", "source", "branches", "head", "along"), "ss-placed")
    found = anchors.select("node", "doc_id", "_ss_key", "pos").join(placed, "node")
    found = found.select("doc_id", "_ss_key", "pos", (F.col("source") < F.col("doc_id")).alias("early"), "branches", F.coalesce("head", "node").alias("path"), (F.col("pos") - F.coalesce("along", F.lit(0))).alias("begin"))
    found = found.repartition("doc_id", "_ss_key")  # both aggregates below keep to these partitions
    walk = found.groupBy("doc_id", "_ss_key", "path", "begin", "early", "branches").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    mark = F.shiftleft(F.col("first").cast("long"), 32) + (F.col("last") - F.col("first")).cast("long") * 4 + F.col("early").cast("long") * 2 + F.col("branches").cast("long")
    return walk.groupBy("doc_id", "_ss_key").agg(F.collect_list(mark).alias("marks"))


def _kept(text: bytes, w: Words, i: int, removed: np.ndarray, with_text: bool) -> tuple[int, int, str, str | None]:
    """n_words, n_removed, digest of the kept words and, if wanted, the text of the kept runs."""
    first, last = int(w.first[i]), int(w.first[i + 1])
    gone = removed[first:last]
    words = text.split()
    if not gone.any():
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest(), text.decode() if with_text else None
    keep = ~gone
    kept = None
    if with_text:
        begin = np.flatnonzero(keep & np.concatenate([[True], gone[:-1]])) + first
        end = np.flatnonzero(keep & np.concatenate([gone[1:], [True]])) + first
        base = w.offsets[i]
        kept = b" ".join(text[w.starts[x] - base : w.ends[y] - base] for x, y in zip(begin, end, strict=True)).decode()
    return len(words), int(gone.sum()), hashlib.sha256(b" ".join(compress(words, keep.tolist()))).hexdigest(), kept


def _cover(n: int, runs: np.ndarray) -> np.ndarray:
    """Whether each of n words is in one of the runs, rows (begin, end)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0], 1)
    np.add.at(edge, runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


_RESULT = ["doc_id", "_ss_key", "n_words", "n_removed", "kept_sha256", "kept"]
_RESULT_TYPES = "doc_id long, _ss_key long, n_words long, n_removed long, kept_sha256 string, kept string"


def _first_look(joined: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Rows of three kinds: 0 a finished document, 1 a run of n windows that may be repeated, 2 a document that
    waits for the verdict on runs that may go."""
    names = ["kind", *_RESULT, "h1", "h2", "pos", "n", "early", "text"]
    schema = f"kind int, {_RESULT_TYPES}, h1 long, h2 int, pos int, n int, early boolean, text string"

    def frame(rows: int, **have) -> pa.RecordBatch:
        kinds = {"kind": pa.int32(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept": pa.string(), "h1": pa.int64(), "h2": pa.int32(), "pos": pa.int32(), "n": pa.int32(), "early": pa.bool_(), "text": pa.string(), "doc_id": pa.int64(), "_ss_key": pa.int64()}
        return pa.RecordBatch.from_arrays([have[c] if isinstance(have.get(c), pa.Array) else pa.array(have.get(c, [None] * rows), kinds[c]) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, marks = batch.column(0), batch.column(1), batch.column(3).to_pylist()
            for offset, part in steps(batch.column(2)):
                a = Anchors(part, window)
                w = a.words
                state = np.zeros((3, len(a.at) + 1), np.int64)  # repeated, branching, early
                own = [(i, m) for i, m in enumerate(marks[offset : offset + len(part)]) if m]
                if own and len(a.at):
                    code = np.concatenate([np.array(m, np.int64) for _, m in own])
                    base = np.repeat([w.first[i] for i, _ in own], [len(m) for _, m in own]) + (code >> 32)
                    begin, end = np.searchsorted(a.at, base), np.searchsorted(a.at, base + (code >> 2 & (1 << 30) - 1)) + 1
                    for k, which in enumerate((code >= 0, code & 1 > 0, code & 2 > 0)):
                        np.add.at(state[k], begin[which], 1)
                        np.add.at(state[k], end[which], -1)
                    state = np.cumsum(state, axis=1)
                j = a.deciding()
                left, right = np.searchsorted(a.at, a.starts), np.searchsorted(a.at, a.starts + a.width)
                branch = np.concatenate([[0], np.cumsum(state[1])])
                own = np.flatnonzero(state[0, j] > 0)
                plain = branch[right[own]] == branch[left[own]]
                new = np.ones(len(own), bool)
                new[1:] = ~(plain[1:] & plain[:-1] & (np.diff(a.starts[own]) == 1))
                look = a.starts[own[new]]
                n = np.diff(np.append(np.flatnonzero(new), len(own)))
                early = state[2, j[own[new]]] > 0
                waits = np.zeros(len(part), bool)
                waits[w.row[look[early]]] = True
                none = np.zeros(len(w.hash), bool)
                texts = [(part[i].as_py() or "").encode() if not waits[i] else b"" for i in range(len(part))]
                done = [(i, *_kept(texts[i], w, i, none, with_text)) for i in np.flatnonzero(~waits).tolist()]
                if done:
                    i, words, gone, sha, kept = map(list, zip(*done, strict=True))
                    at = pa.array(np.array(i) + offset)
                    yield frame(len(i), kind=[0] * len(i), doc_id=ids.take(at), _ss_key=keys.take(at), n_words=words, n_removed=gone, kept_sha256=sha, kept=kept)
                if waits.any():
                    i = np.flatnonzero(waits)
                    at = pa.array(i + offset)
                    yield frame(len(i), kind=[2] * len(i), doc_id=ids.take(at), _ss_key=keys.take(at), text=part.take(pa.array(i)).cast(pa.string()))
                if len(look):
                    h1, h2 = (w.runs(s)(look, look + window + n - 1).view(np.int64) for s in (2, 3))
                    h2 = (h2 >> 32).astype(np.int32)
                    row = w.row[look]
                    at = pa.array(row + offset)
                    pos = (look - w.first[row]).astype(np.int32)
                    yield frame(len(look), kind=pa.array(np.ones(len(look), np.int32)), doc_id=ids.take(at), _ss_key=keys.take(at), h1=pa.array(h1), h2=pa.array(h2), pos=pa.array(pos), n=pa.array(n.astype(np.int32)), early=pa.array(early))

    return joined.select("doc_id", "_ss_key", "text", "marks").mapInArrow(run, schema)


def _second_look(waiting: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Finishes documents; the runs that go are in ``more``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            more = batch.column(3)
            for offset, part in steps(batch.column(2)):
                w = Words(part)
                runs = [(w.first[i] + x["pos"], w.first[i] + x["pos"] + window + x["n"] - 1) for i in range(len(part)) for x in more[offset + i].as_py() or ()]
                removed = _cover(len(w.hash), np.array(runs, np.int64).reshape(-1, 2))
                out = [_kept((part[i].as_py() or "").encode(), w, i, removed, with_text) for i in range(len(part))]
                n, gone, sha, kept = map(list, zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(offset, len(part)), batch.column(1).slice(offset, len(part)), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha), pa.array(kept, pa.string())], names=_RESULT)

    return waiting.select("doc_id", "_ss_key", "text", "more").mapInArrow(run, _RESULT_TYPES)


def repeats(docs: DataFrame, window: int = 50, with_text: bool = False) -> DataFrame:
    """(doc_id, _ss_key, n_words, n_removed, kept_sha256, kept) of every row; kept: the text left, if asked for."""
    spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "ss-marks")
    with scratch_folder(spark, "ss-graph"):  # the graph goes, with its shuffles, before texts are moved
        anchors = written(anchor_table(docs, window), "ss-anchors")
        # written before it is joined: Spark splits the partition of a hot node only where both sides come straight from a shuffle
        nodes = written(repeated_nodes(anchors.select("node", "doc_id", "context", "before", "gap")), "ss-nodes")
        marks = stored(walks(anchors, nodes, plain_paths(nodes)), path)
    looked = _first_look(_keyed(docs).join(marks, ["doc_id", "_ss_key"], "left"), window, with_text)
    path = scratch_path(spark, "ss-looked")
    looked.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    looked = spark.read.schema(looked.schema).parquet(path)
    windows = looked.where("kind = 1")
    seen = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("_ss_last")).where("source < _ss_last").select("h1", "h2", "source")
    seen = written(seen, "ss-seen")
    more = windows.where("early").select("h1", "h2", "doc_id", "_ss_key", "pos", "n").join(seen, ["h1", "h2"]).where("source < doc_id")
    more = more.groupBy("doc_id", "_ss_key").agg(F.collect_set(F.struct("pos", "n")).alias("more"))
    waiting = looked.where("kind = 2").select("doc_id", "_ss_key", "text").join(more, ["doc_id", "_ss_key"], "left")
    return looked.where("kind = 0").select(*_RESULT).union(_second_look(waiting, window, with_text))


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with the text that is left in place of ``text``, and its length in place of ``n_chars`` where docs has that."""
    left = repeats(docs, window, with_text=True).select(F.col("doc_id").alias("_ss_id"), "_ss_key", F.col("kept").alias("_ss_kept")).where("_ss_id is not null").dropDuplicates(["_ss_id", "_ss_key"])
    text = F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.coalesce("_ss_kept", F.col("text")))
    own = {"text": text, "n_chars": F.when(F.col("_ss_kept").isNull(), F.col("n_chars")).otherwise(F.char_length("_ss_kept")).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    rows = docs.withColumn("_ss_own", F.xxhash64(F.col("text").cast("string"))).join(left, (F.col("doc_id").cast("long") == F.col("_ss_id")) & (F.col("_ss_own") == F.col("_ss_key")), "left")
    return rows.select(*[own[c].alias(c) if c in own else F.col(f"`{c}`") for c in docs.columns])


def op4_substring(spark, sf_dir: str) -> DataFrame:
    """Words of every document that are left when repeated runs of 50 words go."""
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS m FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT m, min(doc_id) AS source FROM g GROUP BY m),
b AS (SELECT g.doc_id, list(DISTINCT p) AS starts FROM g JOIN f USING (m) WHERE source < doc_id GROUP BY g.doc_id),
c AS (SELECT b.doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 50)))) AS gone FROM b),
k AS (SELECT d.doc_id, d.w, c.gone, [x FOR x, i IN d.w IF gone IS NULL OR NOT list_contains(gone, i)] AS kept FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k
"""
