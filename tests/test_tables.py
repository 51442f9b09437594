"""Versions, numbers that go on, bitmaps and clustered layouts."""

import random

import pytest
from pyspark.sql import functions as F

from grainfield.functions.grid import GridSpec
from grainfield.operators.bitmap import hit_bitmaps, select_by_bitmap
from grainfield.operators.model import fit
from grainfield.operators.select import select_ions
from grainfield.sources.clustered import ClusteredIons, block_of
from grainfield.sources.log import Log
from grainfield.sources.numbering import NumberedTable
from grainfield.sources.snapshots import Snapshots
from grainfield.streaming.select import read_selected, select_newest

SCORES = "voxel_id long, scores array<double>"
IONS = "ion_id long, x float, y float, z float"
GRID = GridSpec((0, 0, 0), (1, 1, 1), (6, 5, 4))


def values(df, c="ion_id"):
    return sorted(r[c] for r in df.select(c).collect())


def ions_of(spark, n=600, seed=1):
    """Positions inside the grid, past its edges on every side, and without a place."""
    rng = random.Random(seed)
    rows = [(i, rng.uniform(-2.5, 8.5), rng.uniform(-2.5, 7.5), rng.uniform(-2.5, 6.5)) for i in range(n)]
    rows += [(n, None, 1.0, 1.0), (n + 1, float("nan"), 1.0, 1.0), (n + 2, 1e30, 1.0, 1.0)]
    return spark.createDataFrame(rows, IONS)


def scores_of(spark, cells, low=0.0):
    rng = random.Random(2)
    return spark.createDataFrame([(c, [rng.uniform(low, 10.0)]) for c in cells], SCORES)


def test_log(spark, tmp_path):
    log = Log(spark, f"{tmp_path}/log")
    assert log.numbers() == [] and log.last() is None and log.get(0) is None
    assert log.add(0, {"a": "ü"}) and log.add(7, {"b": [1]}) and not log.add(7, {"b": [2]})
    assert log.numbers() == [0, 7] and log.get(0) == {"a": "ü"} and log.get(7) == {"b": [1]} and Log(spark, f"file://{tmp_path}/log").last() == 7
    log.drop(7)
    assert log.last() == 0
    with pytest.raises(ValueError):
        log.add(-1, {})


def test_log_loses_a_race(spark, tmp_path, monkeypatch):
    """A record that appears between the look and the rename stays as it is."""
    a, b = Log(spark, f"{tmp_path}/log"), Log(spark, f"{tmp_path}/log")
    b.add(0, {"from": "b"})
    real = a._fs

    class Blind:
        def exists(self, path):
            return False

        def __getattr__(self, name):
            return getattr(real, name)

    monkeypatch.setattr(a, "_fs", Blind())
    assert not a.add(0, {"from": "a"}) and b.get(0) == {"from": "b"} and b.numbers() == [0]


def test_snapshots(spark, tmp_path):
    store = Snapshots(spark, f"{tmp_path}/s")
    with pytest.raises(ValueError):
        store.read("scores")
    one, two = scores_of(spark, range(5)), scores_of(spark, range(5, 12))
    assert store.publish(scores=one, selected=one.select("voxel_id").where("false")) == 0
    early = store.read("scores")
    assert store.publish(scores=two) == 1 and store.latest() == 1
    # a reader that began before the second version still has all of its files, and the first version stays readable
    assert values(early, "voxel_id") == list(range(5)) == values(store.read("scores", 0), "voxel_id")
    assert values(store.read("scores"), "voxel_id") == list(range(5, 12))
    assert store.read("selected").columns == ["voxel_id"] and store.read("selected").count() == 0
    assert store.publish(carry=False, loadings=one) == 2
    for name, version in (("scores", None), ("scores", 9), ("other", 0)):
        with pytest.raises(ValueError):
            store.read(name, version)
    assert store.expire(2) == [0] and values(store.read("scores", 1), "voxel_id") == list(range(5, 12)) and store.read("selected", 1).count() == 0
    with pytest.raises(ValueError):
        store.read("scores", 0)
    assert store.expire(5) == []


def test_snapshots_of_two_writers(spark, tmp_path, monkeypatch):
    """Who finds the number taken takes the next one, with the tables of the version before."""
    a, b = Snapshots(spark, f"{tmp_path}/s"), Snapshots(spark, f"{tmp_path}/s")
    add, once = a.log.add, []

    def late(number, record):
        if not once:
            once.append(b.publish(left=scores_of(spark, [1])))
        return add(number, record)

    monkeypatch.setattr(a.log, "add", late)
    assert a.publish(right=scores_of(spark, [2])) == 1
    assert values(a.read("left"), "voxel_id") == [1] and values(a.read("right"), "voxel_id") == [2]


def test_saved_models_are_versions(spark, tmp_path):
    from grainfield.operators.model import publish_model, read_model

    m = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate([[4, 0], [2, 2], [0, 6], [1, 1]])], "voxel_id long, x array<double>")
    store = Snapshots(spark, f"{tmp_path}/m")
    first, second = fit(m, 2, 1), fit(m, 2, 2)
    assert publish_model(store, first) == 0 and publish_model(store, second) == 1
    for version, model in ((0, first), (1, second), (None, second)):
        got = read_model(store, version)
        assert (got.to_scores == model.to_scores).all() and (got.eigenvalues == model.eigenvalues).all() and got.n == 4


def test_stream_takes_the_newest_version(spark, tmp_path):
    """A model saved between micro-batches is used from the next one on; a batch that runs again keeps its version and its rows."""
    ions, store = ions_of(spark), Snapshots(spark, f"{tmp_path}/s")
    old, new = scores_of(spark, range(0, 60)), scores_of(spark, range(40, 120))
    out, state, folder = f"{tmp_path}/out", f"{tmp_path}/state", f"{tmp_path}/in"

    def feed(part):
        part.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(ions.schema).parquet(folder)
        select_newest(stream, store, GRID, out, state, 0, 5.0).awaitTermination()

    store.publish(scores=old)
    feed(ions.where("ion_id < 300"))
    store.publish(scores=new)
    feed(ions.where("ion_id >= 300"))
    want = {(r["ion_id"], v) for v, s, part in ((0, old, "ion_id < 300"), (1, new, "ion_id >= 300")) for r in select_ions(ions.where(part), s, GRID, 0, 5.0).collect()}
    got = [(r["ion_id"], r["version"]) for r in read_selected(spark, out).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # the second batch as after a failure: its result is gone, its version is not, and a third version is there
    store.publish(scores=scores_of(spark, range(5)))
    Log(spark, f"{out}/_batches").drop(1)
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/commits/1")
    commits.getFileSystem(spark._jsc.hadoopConfiguration()).delete(commits, False)
    select_newest(spark.readStream.schema(ions.schema).parquet(folder), store, GRID, out, state, 0, 5.0).awaitTermination()
    assert sorted((r["ion_id"], r["version"]) for r in read_selected(spark, out).collect()) == sorted(want)
    with pytest.raises(ValueError):
        select_newest(ions, store, GRID, out, state)
    with pytest.raises(ValueError):
        read_selected(spark, f"{tmp_path}/none")


def test_numbers_go_on(spark, tmp_path):
    table = NumberedTable(spark, f"{tmp_path}/t")
    with pytest.raises(ValueError):
        table.read()
    part = lambda a, b: spark.range(a, b).select((-F.col("id")).alias("k"), F.lit("x").alias("v")).repartition(3)
    assert table.append(part(0, 100), ["k"], 0) == (0, 100) and table.append(part(100, 130), ["k"], 1) == (100, 30)
    assert table.append(part(0, 0), ["k"], 2) == (130, 0) and table.mark() == 130
    before = {tuple(r) for r in table.read().collect()}
    assert table.append(part(100, 130), ["k"], 1) == (100, 30) and {tuple(r) for r in table.read().collect()} == before
    assert table.append(part(130, 150), ["k"], 1, source="other") == (130, 20)
    rows = sorted((r["ion_id"], r["k"]) for r in table.read().collect())
    assert rows == list(enumerate([*range(-99, 1), *range(-129, -99), *range(-149, -129)]))


def test_numbers_of_two_writers(spark, tmp_path, monkeypatch):
    a, b = NumberedTable(spark, f"{tmp_path}/t"), NumberedTable(spark, f"{tmp_path}/t")
    add, once = a.log.add, []

    def late(number, record):
        if not once:
            once.append(b.append(spark.range(10), ["id"], 0, "b"))
        return add(number, record)

    monkeypatch.setattr(a.log, "add", late)
    assert a.append(spark.range(20, 25), ["id"], 0, "a") == (10, 5) and once == [(0, 10)]
    assert values(a.read()) == list(range(15))


def test_numbers_of_a_stream(spark, tmp_path):
    """Micro-batches are numbered one after the other, and one that runs again keeps its numbers."""
    table, folder, state = NumberedTable(spark, f"{tmp_path}/t"), f"{tmp_path}/in", f"{tmp_path}/state"

    def run():
        stream = spark.readStream.schema("id long").parquet(folder)
        stream.writeStream.foreachBatch(table.writer(["id"])).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    for k in range(3):
        spark.range(k * 50, k * 50 + 50).coalesce(1).write.mode("append").parquet(folder)
        run()
    commits = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/commits/2")
    commits.getFileSystem(spark._jsc.hadoopConfiguration()).delete(commits, False)
    run()
    assert sorted((r["ion_id"], r["id"]) for r in table.read().collect()) == [(i, i) for i in range(150)]


@pytest.mark.parametrize("bounds", ["wrap", "strict"])
@pytest.mark.parametrize("isovalue", [0.0, 6.0, 99.0])
def test_bitmaps_select_alike(spark, bounds, isovalue):
    ions, scores = ions_of(spark).withColumn("bucket", F.lit(1)), scores_of(spark, range(0, 120), -1.0)
    maps = hit_bitmaps(scores, 0, isovalue)
    for invert in (False, True):
        for few in (4096, 0):
            got = select_by_bitmap(ions, maps, GRID, invert, bounds, few)
            assert got.columns == ions.columns and values(got) == values(select_ions(ions, scores, GRID, 0, isovalue, invert, bounds))


def test_bitmaps_of_many_cells(spark):
    """Hits over many buckets, ids of both signs and at the edges of buckets: every bit is found and no other."""
    rng = random.Random(6)
    hits = {0, 1, -1, 32767, 32768, 32769, -32768, -32769, 2**40, *(rng.randrange(-200_000, 200_000) for _ in range(3000))}
    asked = hits | {h + d for h in hits for d in (-1, 1)}
    scores = spark.createDataFrame([(h, [1.0]) for h in hits], SCORES).repartition(4)
    maps = hit_bitmaps(scores, 0, 0.5)
    assert maps.count() <= 15
    from grainfield.operators.bitmap import in_bitmap

    cells = spark.createDataFrame([(a,) for a in asked] + [(None,)], "cell long")
    got = cells.join(maps, F.bitmap_bucket_number("cell") == F.col("bucket"), "left").where(in_bitmap(F.col("cell"), F.col("words")))
    assert {r["cell"] for r in got.select("cell").collect()} == hits


def test_bitmaps_send_fewer_rows(spark):
    """Where nearly all cells are hits, the join's right side has a row for each 32,768 of them."""
    grid = GridSpec((0, 0, 0), (1, 1, 1), (100, 100, 20))
    scores = spark.range(200_000).select(F.col("id").alias("voxel_id"), F.array(F.lit(1.0)).alias("scores"))
    assert hit_bitmaps(scores, 0, 0.0).count() == 8
    ions = spark.range(5000).select("id", *[((F.col("id") * k) % n).cast("float").alias(c) for k, c, n in ((7, "x", 110), (13, "y", 100), (3, "z", 21))])
    assert values(select_by_bitmap(ions, hit_bitmaps(scores), grid), "id") == values(select_ions(ions, scores, grid), "id")


def test_blocks(spark):
    cells = spark.range(-1, 121).select(F.col("id").alias("cell"), block_of(F.col("id"), GRID, (4, 2, 3)).alias("block"))
    got = {r["cell"]: r["block"] for r in cells.collect()}
    assert got == {c: -1 if not 0 <= c < 120 else (c % 6) // 4 + 2 * ((c // 6 % 5) // 2) + 6 * (c // 30 // 3) for c in range(-1, 121)}


@pytest.mark.parametrize("bounds", ["wrap", "strict"])
def test_clustered_selects_alike(spark, tmp_path, bounds):
    ions, scores = ions_of(spark).withColumn("extra", F.col("ion_id") * 2), scores_of(spark, range(0, 120))
    laid = ClusteredIons.write(ions, f"{tmp_path}/ions", GRID, (2, 2, 2), bounds)
    again = ClusteredIons(spark, f"{tmp_path}/ions")
    assert again.grid == GRID and again.bounds == bounds and sorted(map(repr, again.read().collect())) == sorted(map(repr, ions.collect()))
    for isovalue in (0.0, 9.0, 99.0):
        for invert in (False, True):
            got = laid.select(scores, 0, isovalue, invert)
            assert got.columns == ions.columns and values(got) == values(select_ions(ions, scores, GRID, 0, isovalue, invert, bounds))


@pytest.mark.parametrize("invert", [False, True])
def test_clustered_computes_scores_once(spark, tmp_path, invert):
    """Scores that are still to be computed are so once, and neither blocks nor cells become filters of the rows they are made from."""
    seen, ions, scores = spark.sparkContext.accumulator(0), ions_of(spark), scores_of(spark, range(0, 120))
    laid = ClusteredIons.write(ions, f"{tmp_path}/ions", GRID, (2, 2, 2))

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    lazy = scores.mapInArrow(counted, SCORES)
    picked = laid.select(lazy, 0, 5.0, invert)
    assert values(picked) == values(select_ions(ions, scores, GRID, 0, 5.0, invert)) and seen.value == 120


def test_clustered_reads_hit_blocks_only(spark, tmp_path):
    ions = ions_of(spark, 3000)
    laid = ClusteredIons.write(ions, f"{tmp_path}/ions", GRID, (2, 2, 2))
    scores = spark.createDataFrame([(c, [10.0 if c in (0, 1, 6) else 0.0]) for c in range(120)], SCORES)
    picked = laid.select(scores, 0, 5.0)
    assert values(picked) == values(select_ions(ions, scores, GRID, 0, 5.0))
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    total = laid.table().count()

    def scanned(node):
        """Rows that the scan of the ions gave."""
        kids = node.children()
        found = [node.metrics().apply("numOutputRows").value()] if node.nodeName().startswith("Scan parquet") and node.metrics().contains("numOutputRows") else []
        inner = [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if node.nodeName().endswith("QueryStage") else []
        return found + [x for k in [*(kids.apply(i) for i in range(kids.size())), *inner] for x in scanned(k)]

    picked.collect()
    rows = max(scanned(picked._jdf.queryExecution().executedPlan()))
    in_block = laid.table().where("block = 0").count()
    assert rows == in_block < total / 5


def test_clustered_refuses(spark, tmp_path):
    ions = ions_of(spark, 3)
    for side, df in (((0, 1, 1), ions), ((1, 1, 1), ions.withColumn("block", F.lit(1)))):
        with pytest.raises(ValueError):
            ClusteredIons.write(df, f"{tmp_path}/no", GRID, side)
    with pytest.raises(ValueError):
        ClusteredIons.write(ions, f"{tmp_path}/no", GridSpec((0, 0, 0), (1, 1, 1), (1000, 1000, 1)), (1, 1, 1))
    with pytest.raises(ValueError):
        ClusteredIons(spark, f"{tmp_path}/no")
