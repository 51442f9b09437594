"""Near-duplicate documents by a fast similarity sketch, banding and exact verification.

The sketch has t coordinates. In round i every shingle throws a hash into one random bin of t; a bin keeps the
smallest value, and values of earlier rounds are smaller. After t rounds, rounds t to 2t - 1 fill bin i - t with all
shingles, so that no coordinate stays empty, and coordinates agree with probability equal to the Jaccard similarity,
concentrated as if they were independent. Most documents are full after a few rounds, so a sketch takes far
less than t passes over the set.

Documents with equal sets are one class and stand for each other. Bands of coordinates give buckets of classes. Every pair that shares
a bucket is decided on the full sets, in two steps. First each class is compared with the smallest class of one of its buckets, that
with which it shares most bands: so copies of one text become one component by as many comparisons as there are copies. Then
only buckets that still hold several components are left (those that overlap are taken together where that moves less), and all their
pairs whose sizes allow a link are compared, in pairs of tiles: a tile pair computes exact intersections as one product and gives a spanning forest of its links. Tiles and the parts of a star
are bounded by the shingles in them, no pairs are rows, and a large bucket is the work of many tasks.

Nulls and odd cases: null texts and texts without words have an empty set, are linked with nothing and are
kept. A text of fewer words than a shingle is one shingle. A null id is linked with nothing, has a null component
and is kept. Rows that share an id count as one document that has each of the texts; ``dedup`` judges each such row by its own
text, and keeps one of repeated rows. Empty tables give empty results. Other columns pass through ``dedup``; ``_mh_*`` is reserved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, mix64, scratch_folder, scratch_path, steps, stored, written
from .components import connected_components, join_roots


@dataclass(frozen=True)
class Settings:
    """words: of a shingle; percent: least similarity; bands, rows: of the sketch (a pair at 80 % is missed with probability 5e-7)."""

    words: int = 5
    percent: int = 80
    bands: int = 48
    rows: int = 6


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct k-word shingles of each text, sorted, one after another, and where each text's start."""
    w = Words(texts, lower=True)
    grams = w.grams(k)
    sets = []
    for first, last in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        n = last - first
        if n >= k:
            own = np.sort(grams[first : last - k + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            sets.append(own[keep])
        elif n:
            h = np.zeros(1, np.uint64)
            for i in range(first, last):
                h = mix64(h + w.hash[i : i + 1])
            sets.append(h)
        else:
            sets.append(np.zeros(0, np.uint64))
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), off


_EMPTY = np.uint64(2**64 - 1)


def sketches(flat: np.ndarray, off: np.ndarray, t: int) -> np.ndarray:
    """Sketch of each set, t coordinates a row; rows of empty sets stay empty."""
    n = len(off) - 1
    out = np.full(n * t, _EMPTY, np.uint64)
    row = np.repeat(np.arange(n), np.diff(off))
    for i in range(2 * t):
        h = mix64(flat + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        at = (h >> np.uint64(33)) % np.uint64(t) if i < t else np.uint64(i - t)
        np.minimum.at(out, row * t + at.astype(np.int64), (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
        if i % 4 == 3 or i >= t:
            left = (out.reshape(n, t) == _EMPTY).any(1)[row]
            if not left.all():
                flat, row = flat[left], row[left]
            if not len(flat):
                break
    return out.reshape(n, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band, different for different bands."""
    out = np.empty((len(sketch), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sketch), b + 1, np.uint64)
        for j in range(rows):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + sketch[:, b * rows + j])
        out[:, b] = h
    return out


def sketched(docs: DataFrame, s: Settings) -> DataFrame:
    """(doc_id, text_hash, n_shingles, fp1, fp2, keys): size, 128-bit fingerprint and band hashes of each set; no bands without a shingle or an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in steps(batch.column(2)):
                flat, off = shingle_sets(part, s.words)
                size, fp = np.diff(off), _fingerprints(flat, off)
                ids = batch.column(0).slice(first, len(part))
                some = (size > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
                _, one, same = np.unique(fp[0], return_index=True, return_inverse=True)
                own = np.concatenate([flat[off[i] : off[i + 1]] for i in one] or [flat])
                bands = band_keys(sketches(own, np.concatenate([[0], np.cumsum(size[one])]), s.bands * s.rows), s.bands, s.rows)[same]
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * s.bands)]).astype(np.int32)), pa.array(bands[some].ravel().view(np.int64)))
                fp = fp.view(np.int64)
                yield pa.RecordBatch.from_arrays([ids, batch.column(1).slice(first, len(part)), pa.array(size), pa.array(fp[0]), pa.array(fp[1]), keys], names=names)

    names = ["doc_id", "text_hash", "n_shingles", "fp1", "fp2", "keys"]
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, fp1 long, fp2 long, keys array<long>")


def _fingerprints(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.zeros((2, len(flat) + 1), np.uint64)
    np.cumsum(mix64(flat ^ np.uint64(0x5851F42D4C957F2D)), out=sums[0, 1:])
    np.cumsum(mix64(flat ^ np.uint64(0x14057B7EF767814F)), out=sums[1, 1:])
    return sums[:, off[1:]] - sums[:, off[:-1]]


def _star(percent: int):
    """Links of sets to the set of their star, by exact intersections."""

    def run(table: pa.Table) -> pa.Table:
        hub, ids = table.column("hub")[0].as_py(), table.column("fp1").to_numpy()
        hashes = table.column("hashes").combine_chunks()
        size = np.asarray(hashes.value_lengths(), np.int64)
        off, flat = np.concatenate([[0], np.cumsum(size)]), np.asarray(hashes.flatten()).view(np.uint64)
        row, found = np.repeat(np.arange(len(ids)), size), np.zeros(len(ids), bool)
        for c in np.flatnonzero(ids == hub):  # one, unless two sets have one fingerprint half
            own = flat[off[c] : off[c + 1]]
            place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            common = np.bincount(row[own[place] == flat], minlength=len(ids))
            found |= 100 * common >= percent * (size + size[c] - common)
        found &= ids != hub
        return pa.table({"u": pa.array(ids[found]), "v": pa.array(np.full(found.sum(), hub, np.int64))})

    return run


def _verified(percent: int):
    """A spanning forest of the links between the sets of two tiles (or of one), by exact intersections."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("fp1").to_numpy()
        same = table.column("lo")[0].as_py() == table.column("hi")[0].as_py()
        side = np.ones(len(ids), bool) if same else table.column("tile").to_numpy() == table.column("lo")[0].as_py()
        first, second = np.flatnonzero(side), np.arange(len(ids)) if same else np.flatnonzero(~side)
        hashes = table.column("hashes").combine_chunks()
        size = np.asarray(hashes.value_lengths(), np.int64)
        row = np.repeat(np.arange(len(ids)), size)
        _, column, times = np.unique(np.asarray(hashes.flatten()), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        row, column = row[shared], column[shared]
        order = np.argsort(column, kind="stable")
        row, column = row[order], np.unique(column[order], return_inverse=True)[1]
        common = np.zeros((len(first), len(second)))
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            a, b = np.searchsorted(column, (c, c + 4096))
            has = np.zeros((len(ids), int(column[b - 1]) - c + 1), np.float32)
            has[row[a:b], column[a:b] - c] = 1
            common += has[first] @ has[second].T
        i, j = np.nonzero(100 * common >= percent * (size[first][:, None] + size[second][None] - common))
        i, j = first[i], second[j]
        parent = join_roots(np.arange(len(ids)), i[i != j], j[i != j])
        child = np.flatnonzero(parent != np.arange(len(ids)))
        return pa.table({"u": ids[child], "v": ids[parent[child]]})

    return run


#: Most sets of a tile; shingles of a tile or of a part of a star, on average; width of a class of sizes in a bucket of several tiles (natural logarithm).
TILE, SHINGLES, WIDTH = 512, 1 << 18, 0.1


#: Most bytes of candidates' ids that are broadcast to the texts; with more, texts and ids meet by shuffle.
BROADCAST = 32 << 20


def _parts(n: str) -> Column:
    """Tiles for the sets of a group, by their number and their shingles."""
    return F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum(n) / SHINGLES)).cast("int")


def _dealt(members: DataFrame, s: Settings) -> DataFrame:
    """(g, lo, hi, tile, fp1): every member of a bucket g for each pair of tiles that it has part in.

    A small bucket is one tile. In a larger one tiles hold sets of about one size, and only tiles whose sizes allow the similarity are paired.
    """
    rows = members.count()
    groups = written(members.groupBy("g").agg((_parts("n") > 1).alias("large")), "mh-large", rows)
    counted = written(members.join(groups, "g").withColumn("cls", F.when(F.col("large"), F.floor(F.log("n") / WIDTH)).otherwise(0).cast("long")), "mh-counted", rows)
    parts = written(counted.groupBy("g", "cls").agg(_parts("n").alias("parts")), "mh-parts", rows)
    own = counted.join(parts, ["g", "cls"]).select("fp1", "g", (F.col("cls") * (1 << 24) + F.pmod(F.xxhash64("fp1"), F.col("parts"))).alias("tile"))
    tiles = parts.select("g", "cls", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k")).select("g", "cls", (F.col("cls") * (1 << 24) + F.col("k")).alias("tile"))
    reach = int(np.log(100 / s.percent) / WIDTH) + 1
    # each tile meets the tiles of its own and the next classes, by an equal join for each step
    near = tiles.select("g", F.col("tile").alias("lo"), F.explode(F.sequence(F.col("cls"), F.col("cls") + reach)).alias("cls"))
    pairs = written(near.join(tiles.withColumnRenamed("tile", "hi"), ["g", "cls"]).where("lo <= hi").select("g", "lo", "hi"), "mh-pairs")
    left = own.join(pairs.withColumn("tile", F.col("lo")), ["g", "tile"])
    right = own.join(pairs.where("lo < hi").withColumn("tile", F.col("hi")), ["g", "tile"])
    return left.unionByName(right).select("g", "lo", "hi", "tile", "fp1")


def _sets(docs: DataFrame, members: DataFrame, s: Settings) -> DataFrame:
    """(fp1, hashes): the sets of the members (rep, fp1, fp2), made from the text of the document rep that has these fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in steps(batch.column(0)):
                flat, off = shingle_sets(part, s.words)
                fp, want = _fingerprints(flat, off).view(np.int64), [batch.column(i).slice(first, len(part)).to_numpy() for i in (1, 2)]
                hashes = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(flat.view(np.int64)))
                right = pa.array((fp[0] == want[0]) & (fp[1] == want[1]))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(first, len(part)), hashes], names=["fp1", "hashes"]).filter(right)

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    few = members.count() * 24 <= BROADCAST  # three longs each; texts are not moved then
    made = written(texts.join(F.broadcast(members) if few else members, "rep").select("text", "fp1", "fp2").mapInArrow(run, "fp1 long, hashes array<long>"), "mh-sets")
    if made.count() > members.count():  # repeated rows
        made = written(made.dropDuplicates(["fp1", "hashes"]), "mh-sets")
    return made


def _linked(docs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """(u, v): edges between classes, by fp1, that connect what links of pairs sharing a bucket connect; a table, without those it is made of."""
    path = scratch_path(docs.sparkSession, "mh-links")
    with scratch_folder(docs.sparkSession, "mh-linked"):
        return stored(_links(docs, classes, s), path)


def _links(docs: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """The edges of ``_linked``."""
    n = classes.count()
    bands = classes.select("fp1", F.explode("keys").alias("key"))
    hubs = written(bands.groupBy("key").agg(F.min("fp1").alias("hub"), F.max("fp1").alias("_mh_last")).where("hub < _mh_last").select("key", "hub"), "mh-hubs", n * s.bands)
    entries = written(bands.join(hubs, "key").distinct(), "mh-entries", n * s.bands)
    members = classes.drop("keys").join(entries.select("fp1").distinct(), "fp1", "left_semi")
    members = written(members, "mh-members", n)
    sets = _sets(docs, members.select("rep", "fp1", "fp2"), s)

    # each class against the hub with which it shares most bands
    shared = entries.where("fp1 <> hub").groupBy("fp1", "hub").agg(F.count("*").alias("times"))
    best = shared.groupBy("fp1").agg(F.max(F.struct("times", "hub"))["hub"].alias("hub"))
    best = written(best.join(members.select("fp1", "n"), "fp1"), "mh-best", n)
    stars = written(best.groupBy("hub").agg(F.ceil(F.sum("n") / SHINGLES).cast("int").alias("parts")), "mh-stars", n)
    rays = best.join(stars, "hub").select("fp1", "hub", F.pmod(F.xxhash64("fp1"), F.col("parts")).alias("part"))
    hearts = stars.select(F.col("hub").alias("fp1"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)).alias("part"))
    work = rays.unionByName(hearts).join(sets, "fp1")
    links = written(work.groupBy("hub", "part").applyInArrow(_star(s.percent), "u long, v long"), "mh-star-links")
    found = written(connected_components(links, links.count()), "mh-found", n)

    # buckets that still hold several components, one of those with the same members
    label = entries.join(found.withColumnRenamed("node", "fp1"), "fp1", "left").select("key", "fp1", F.coalesce("component", "fp1").alias("component"))
    marks = [F.bit_xor(F.xxhash64("fp1", F.lit(i))).alias(f"m{i}") for i in (1, 2)]
    open_ = label.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("m0"), *marks).where("a < b")
    open_ = written(open_.groupBy("m0", "m1", "m2").agg(F.min("key").alias("key")).select("key"), "mh-open", n * s.bands)
    left = written(entries.join(open_, "key").join(members.select("fp1", "n"), "fp1").select("fp1", "n", "key", "hub"), "mh-left", n * s.bands)
    pairs = _dealt(_cheapest(left), s).join(sets, "fp1")
    more = pairs.groupBy("g", "lo", "hi").applyInArrow(_verified(s.percent), "u long, v long")
    return found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)


def _cheapest(left: DataFrame) -> DataFrame:
    """(fp1, n, g): groups whose pairs are all compared, from rows (fp1, n, key, hub) of buckets.

    Buckets that overlap, directly or over others, are one group where that moves fewer shingles: a set is in it once, and goes to as
    many tile pairs as the group has tiles. A chain of buckets too long for that stays in its buckets.
    """
    rows = left.count()
    chains = connected_components(left.select(F.col("fp1").alias("u"), F.col("hub").alias("v")), rows)
    placed = written(left.join(chains.select(F.col("node").alias("fp1"), F.col("component").alias("chain")), "fp1"), "mh-placed", rows)
    once = placed.groupBy("chain", "fp1").agg(F.first("n").alias("n"), F.sum("n").alias("apart"))
    costs = once.groupBy("chain").agg((F.sum("n") * _parts("n") <= F.sum("apart")).alias("whole"))
    chosen = written(placed.join(written(costs, "mh-costs", rows), "chain"), "mh-chosen", rows)
    return written(chosen.select("fp1", "n", F.when(F.col("whole"), F.col("chain")).otherwise(F.xxhash64("key", "chain")).alias("g")).distinct(), "mh-groups", rows)


def _classes(table: DataFrame) -> DataFrame:
    real = table.where("n_shingles > 0 and doc_id is not null")
    return written(real.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")), "mh-classes", table.count())


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs."""
    table = written(sketched(docs, settings), "mh-sketched").drop("text_hash")
    classes = _classes(table)
    links, n = _linked(docs, classes, settings), classes.count()
    # the texts of an id are one document
    one = table.where("n_shingles > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("fp1").alias("u"), F.max("fp1").alias("w")).where("u < w")
    rest = table.where("n_shingles > 0").join(one.select("doc_id", "u"), "doc_id").select("u", F.col("fp1").alias("v"))
    found = connected_components(links.union(rest), links.count() + table.count())
    label = classes.select("fp1", "fp2", "rep").join(found.withColumnRenamed("node", "fp1"), "fp1", "left")
    label = written(label.select("fp1", "fp2", "rep", F.coalesce("component", "fp1").alias("c")), "mh-labels", n)
    smallest = written(label.groupBy("c").agg(F.min("rep").alias("component")), "mh-smallest", n)
    label = written(label.join(smallest, "c").select("fp1", "fp2", "component"), "mh-labels", n)
    out = table.drop("keys").join(label, ["fp1", "fp2"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def dedup(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that stay: of each group of near-duplicates one with the smallest id, one of repeated rows, and all without a set or an id."""
    table = written(sketched(docs, settings), "mh-sketched")
    classes = _classes(table)
    links = _linked(docs, classes, settings)
    found = connected_components(links, links.count())
    label = classes.select("fp1", "fp2", "rep").join(found.withColumnRenamed("node", "fp1"), "fp1", "left")
    # the class that stays has the smallest document of its component; of several such, the smallest fingerprint
    best = label.groupBy(F.coalesce("component", "fp1")).agg(F.min(F.struct("rep", "fp1", "fp2")).alias("b")).select("b.*")
    best = written(best, "mh-best", classes.count())
    own = table.where("doc_id is not null").select("doc_id", "text_hash", "n_shingles", "fp1", "fp2")
    stays = own.where("n_shingles > 0").join(best.withColumnRenamed("rep", "doc_id"), ["doc_id", "fp1", "fp2"], "left_semi").unionByName(own.where("n_shingles = 0"), allowMissingColumns=True)
    stays = stays.groupBy("doc_id", "fp1", "fp2").agg(F.min("text_hash").alias("text_hash"), F.count("*").alias("rows"))
    stays = written(stays.select(F.col("doc_id").alias("_mh_id"), F.col("text_hash").alias("_mh_text"), F.col("rows").alias("_mh_rows")), "mh-stays", table.count())
    rows = docs.withColumn("_mh_own", F.xxhash64(F.col("text").cast("string"))).join(stays, (F.col("doc_id").cast("long") == F.col("_mh_id")) & (F.col("_mh_own") == F.col("_mh_text")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    once = rows.where("_mh_rows = 1")
    # of repeated rows any one: the others differ in other columns at most
    whole = F.struct(*names)
    again = rows.where("_mh_rows > 1").groupBy("_mh_id", "_mh_text").agg(F.first(whole).alias("_mh_row")).select(*[F.col("_mh_row").getField(c).alias(c) for c in docs.columns])
    return once.select(*names).union(again).union(docs.where("doc_id is null").select(*names))


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by two-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Settings(words=2))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM s),
l AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
p AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT u, v FROM p UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u),
c AS (SELECT u AS doc_id, min(v) AS m FROM r GROUP BY u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id))::BIGINT AS component_id, doc_id <= coalesce(m, doc_id) AS kept FROM s LEFT JOIN c USING (doc_id)
"""
