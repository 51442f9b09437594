"""Operators on vectors, conversations and pages against brute force, and on odd rows."""

import collections
import gzip
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from grainfield.llm import chat, embed_dedup, knn, queries, warc

VECTORS = "vec_id long, embedding array<float>, label int"
TURNS = "conv_id long, turn long, role string, text string"
PAGES = "page_id long, url string, html string"
BAD = [None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [float("nan"), 1.0, 0.0], [float("inf"), 1.0, 0.0]]


def vectors(n=260, dim=3, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(v) for v in np.float32(rng.normal(size=dim))], int(rng.integers(3))) for i in range(n)]
    rows += [(n + i, rows[5][1], rows[5][2]) for i in range(30)]
    rows += [(n + 40 + i, v, 1) for i, v in enumerate(BAD)]
    return rows + [(n + 60, [1.0, 2.0, 3.0], None), (n + 61, [1.0, 2.0], 1), (n + 62, [2.0, 4.0], 1), (None, [1.0, 2.0, 3.0], 1)]


def fine(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("tile", [2048, 20])
def test_embedding_dedup(spark, monkeypatch, tile):
    monkeypatch.setattr(embed_dedup, "TILE", tile)
    rows = vectors()
    got = {r["vec_id"]: r for r in embed_dedup.near_duplicate_vectors(spark.createDataFrame(rows, VECTORS).withColumn("rep", F.lit(0)).repartition(3)).collect()}
    good = [r for r in rows if r[0] is not None and r[2] is not None and fine(r[1]) and any(r[1])]
    links = collections.defaultdict(set)
    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1]), np.array(b[1])
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    links[a[0]].add(b[0])
                    links[b[0]].add(a[0])
    for r in rows:
        reach, todo = {r[0]}, [r[0]]
        while todo:
            todo = [y for x in todo for y in links[x] if y not in reach and not reach.add(y)]
        own = got[r[0]]
        assert (own["n_links"], own["component_id"]) == (len(links[r[0]]), min(reach, key=lambda v: (v is None, v)))
        assert own["kept"] == (r[0] == own["component_id"])
    assert embed_dedup.near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 64)) * 10.0 ** rng.integers(-200, 150, (200, 1))
    q = embed_dedup.Quantised.of(x)
    at = np.repeat(np.arange(200), 200), np.tile(np.arange(200), 200)
    cos = embed_dedup.cosines(x[at[0]], x[at[1]]).reshape(200, 200)
    about = (q.q.astype(float) @ q.q.T) * np.outer(q.scale, q.scale)
    bound = q.error[:, None] + np.outer(q.length, q.error)
    assert (np.abs(cos - about) <= bound + 1e-12).all() and bound.max() < 0.1
    closer = q.fine(np.arange(200)) @ q.fine(np.arange(200)).T
    bound = q.fine_error[:, None] + np.outer(1 + q.fine_error, q.fine_error)
    assert (np.abs(cos - closer) <= bound + 1e-12).all() and bound.max() < 1e-3


def test_only_open_pairs_need_doubles():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1, 64)) + rng.normal(size=(600, 64)) * 0.27
    q = embed_dedup.Quantised.of(x)
    certain, still = (sorted((int(i), int(j)) for p, r, sure in embed_dedup.compared(q, q, 0.93, True) if sure == want for i, j in zip(p, r)) for want in (True, False))
    i, j = np.triu_indices(600, 1)
    linked = {(int(a), int(b)) for a, b, c in zip(i, j, embed_dedup.cosines(x[i], x[j])) if c >= 0.93}
    assert 1000 < len(linked) < 179000 and set(certain) <= linked <= set(certain) | set(still)
    assert len(set(certain) | set(still)) == len(certain) + len(still) and len(still) < 0.01 * len(i)


def test_embedding_dedup_at_the_threshold(spark):
    """Pairs within 1e-6 of the threshold, on both sides: only doubles can tell."""
    rows = []
    for k in range(40):
        c = 0.93 + (1e-6 if k % 2 else -1e-6)
        rows += [(2 * k, [1.0, 0.0, 0.0, 0.0], k), (2 * k + 1, [c, (1 - c * c) ** 0.5, 0.0, 0.0], k)]
    got = embed_dedup.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == {2 * k + e: k % 2 for k in range(40) for e in (0, 1)}


def best(rows, k=20):
    good = [(r[0], [int(np.floor(64 * float(np.float32(x)))) for x in r[1]]) for r in rows if r[0] is not None and fine(r[1])]
    out = {}
    for q, a in good:
        if q % 20 == 0:
            own = sorted(((-sum(x * y for x, y in zip(a, b)), v) for v, b in good if v != q))
            out[q] = [(v, -s) for s, v in own[:k]]
    return out


@pytest.mark.parametrize(("dim", "k"), [(3, 20), (16, 3)])
def test_topk(spark, dim, k, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK", 16)
    monkeypatch.setattr(knn, "QUERIES", 4)
    monkeypatch.setattr(knn, "GROWTH", 2)
    rows = vectors(dim=dim)
    index = knn.Index(spark.createDataFrame(rows, VECTORS).withColumn("r", F.lit("x")).repartition(3))
    got = collections.defaultdict(dict)
    for r in knn.top_k(index, F.col("vec_id") % 20 == 0, k).collect():
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    want = best(rows, k)
    assert {q: [v[i] for i in range(1, len(v) + 1)] for q, v in got.items()} == want


def test_topk_in_annuli(spark):
    """Enough rows for several annuli a pivot: a small share of them is searched, with the answers of brute force."""
    rng = np.random.default_rng(8)
    n, dim = 20_000, 10
    centres = rng.normal(size=(150, dim)) * 4
    x = np.floor(64 * (centres[rng.integers(0, 150, n)] + rng.normal(size=(n, dim)) * 0.4).astype(np.float32).astype(float))
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(n), "embedding": pa.array(list((x / 64).astype(np.float32)))}))
    index = knn.Index(df)
    assert len(index.cells.cell) > 1.5 * len(index.cells.pivots)
    got = collections.defaultdict(list)
    for r in knn.top_k(index, F.col("vec_id") % 400 == 0, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in range(0, n, 400):
        scores = (x @ x[q]).astype(int)
        own = np.lexsort((np.arange(n), -scores))
        assert got[q] == [(int(i), int(scores[i])) for i in own[own != q][:20]]
    assert len(got) == n // 400 and index.looked.value < 0.25 * n * len(got)


def test_topk_stops_in_clusters(spark):
    """In clustered vectors less than a fifth of the rows is searched, with the same answers."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 12)) * 3
    rows = [(i, [float(v) for v in np.float32(centres[i % 40] + rng.normal(size=12) * 0.1)], 1) for i in range(2400)]
    index = knn.Index(spark.createDataFrame(rows, VECTORS).repartition(3))
    got = collections.defaultdict(list)
    for r in knn.top_k(index, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == best(rows)
    assert 0 < index.looked.value < 0.2 * len(got) * len(rows)


def test_topk_odd_rows(spark):
    assert knn.top_k(knn.Index(spark.createDataFrame([], VECTORS)), F.col("vec_id") % 20 == 0).count() == 0
    assert knn.top_k(knn.Index(spark.createDataFrame([(1, [1.0], 1)], VECTORS)), F.col("vec_id") % 20 == 0).count() == 0
    assert knn.top_k(knn.Index(spark.createDataFrame([(20, [1.0], 1)], VECTORS)), F.col("vec_id") % 20 == 0).count() == 0
    rows = [(20, [1.0], 1), (20, [1.0], 1), (21, [3.4e38], 1), (22, [-3.4e38], 1), (23, [2.0], 1), (23, [2.0], 1)]
    got = knn.top_k(knn.Index(spark.createDataFrame(rows, VECTORS)), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(21, 2**63 - 1), (23, 8192), (23, 8192), (22, -(2**63))]


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x = np.floor(64 * rng.normal(size=(300, 8)))
    pivots = knn.choose_pivots(x, 5)
    d = knn._distances(x, pivots)
    at, r = d.argmin(1), d.min(1)
    rows = [{"cell": p, "pivot": p, "n": int((at == p).sum()), "low": r[at == p].min(), "high": r[at == p].max(), "norm": np.sqrt((x[at == p] ** 2).sum(1)).max()} for p in range(5)]
    bounds = knn.Cells(rows, pivots).bounds(x)
    assert all((x @ x[at == p].T).max(1)[i] <= bounds[i, p] for p in range(5) for i in range(300))


def turns(seed=2):
    rng = random.Random(seed)
    bits = ["<|turn|>", "\\", "\\l", "<|", "<", "|>", "<|end|>\n", "\n", "word ", "ä ", "<|text|>", "\\b"]
    rows = []
    for c in [*range(25), None]:
        n = rng.choice([1, 2, 5, 40])
        for t in range(n):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", None, "to<|ol"])
            rows.append((c, t, role, rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randint(1, 120)))])))
    return rows + [(3, 0, "user", "tie"), (3, 0, "user", "tie"), (4, None, "assistant", "first of all")]


@pytest.mark.parametrize("settings", [chat.Settings(), chat.Settings(60, 10, 10), chat.Settings(3, 1, 1)])
def test_chat(spark, settings):
    rows = turns()
    out = chat.windows(spark.createDataFrame(rows, TURNS).withColumn("window", F.lit(1)).repartition(3), settings)
    read = out.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("target")).collect()
    own = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own[r[0]].append((r[2] or "", r[3] or ""))
    got = collections.defaultdict(list)
    for r in sorted(read, key=lambda r: r["window"]):
        got[r["conv_id"]].append(r)
    assert set(got) == set(own)
    for c, said in own.items():
        assert [tuple(t) for r in got[c] for t in r["turns"]] == said
        assert "".join(r["target"] for r in got[c]) == "".join(t for role, t in said if role == "assistant")
        for r in got[c]:
            tokens = sum(len(t["text"].encode().split()) for t in r["turns"])
            assert len(r["turns"]) == 1 or tokens <= 2 * settings.stride
            if r["window"] and said[0][0] == "system" and len(said[0][1].encode().split()) <= settings.system:
                assert r["formatted"].startswith("<|again|>system<|text|>")
    if settings.budget == 60:
        assert any("<|again|>user" in r["formatted"] for r in read) and max(len(v) for v in got.values()) > 3
    assert chat.windows(spark.createDataFrame([], TURNS)).count() == 0


@pytest.mark.parametrize(("system", "whole"), [(128, 1024), (129, 1024), (500, 1024), (897, 1024), (2000, 2000)])
def test_chat_repeats_long_system_turns(spark, system, whole):
    rows = [(1, 0, "system", "s " * system)] + [(1, t, ["assistant", "user"][t % 2], f"{t} " * 40) for t in range(1, 60)]
    got = sorted(chat.windows(spark.createDataFrame(rows, TURNS)).collect(), key=lambda r: r["window"])
    assert len(got) > 3 and all(r["formatted"].count("system<|text|>" + "s " * system) == 1 for r in got)
    for r in got:
        turns = [x.split("<|text|>")[1].split("<|end|>")[0] for x in r["formatted"].split("|>system")[-1].split("<|end|>\n")[1:] if x]
        assert len(turns) <= 4 or system + sum(len(x.split()) for x in turns) <= whole
    assert [x for r in got for x in re.findall(r"<[|]turn[|]>\w+<[|]text[|]>(\d+)", r["formatted"])] == [str(t) for t in range(1, 60)]


def pages():
    big = "<html>" + "x" * 200
    return [(5, "http://a/1", big), (2, "http://b", big), (9, "http://c", big), (2, "http://b", big), (1, "u\r\nv", "short"), (3, None, "short"), (4, "http://d", None), (6, "http://e", ""), (None, "http://f", big + "y"), (None, "http://g", big + "y"), (7, "http://h", big + "y"), (8, "http://i", "WARC/1.1\r\n\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello" * 5), (10, "x", "é\x00" * 100)]


def test_warc(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, PAGES).withColumn("uid", F.lit(1)).withColumn("digest", F.lit("x")).coalesce(1).sortWithinPartitions("page_id")
    df.write.parquet(f"{tmp_path}/in")
    warc.write(spark.read.parquet(f"{tmp_path}/in"), f"{tmp_path}/out", records_per_file=9)
    read = warc.read(spark, f"{tmp_path}/out", with_payload=True).cache()
    assert read.count() == 3 * len(rows) and spark.read.format("binaryFile").load(f"{tmp_path}/out").count() > 3
    assert read.where("record_type = 'response' and declared_digest <> payload_digest").count() == 0
    got = warc.assemble(read).withColumn("page", warc.page_id(F.col("metadata"))).collect()
    assert len(got) == len(rows) and all(len(r["requests"]) == len(r["metadata"]) == 1 for r in got)
    kinds = collections.Counter((r["page"], r["record_type"]) for r in got)
    assert kinds == collections.Counter({(5, "revisit"): 1, (2, "response"): 1, (2, "revisit"): 1, (9, "revisit"): 1, (1, "response"): 1, (3, "response"): 1, (4, "response"): 1, (6, "response"): 1, (None, "revisit"): 2, (7, "response"): 1, (8, "response"): 1, (10, "response"): 1})
    html = {r[0]: r[2] or "" for r in rows}
    for r in got:
        if r["record_type"] == "response":
            assert bytes(r["response"]["payload"]).decode() == html[r["page"]] and r["original"] is None
        else:
            assert r["original"]["payload_bytes"] in (206, 207) and r["response"]["payload_bytes"] == 0
    assert {r["target_uri"] for r in got if r["page"] in (1, 3)} == {"u%0D%0Av", None}
    warc.write(spark.createDataFrame([], PAGES), f"{tmp_path}/none")
    assert warc.read(spark, f"{tmp_path}/none").count() == 0


def test_warc_long_pages(spark, tmp_path):
    """Archives of long pages hold fewer records."""
    rows = [(i, f"u{i}", "x" * (50_000 if i % 10 == 0 else 10) + str(i // 20)) for i in range(60)]
    warc.write(spark.createDataFrame(rows, PAGES).coalesce(1), f"{tmp_path}/out", records_per_file=30, file_bytes=120_000)
    files = spark.read.format("binaryFile").load(f"{tmp_path}/out").select("content").collect()
    sizes = [[len(b) for _, b in warc.parse(bytes(r["content"]))] for r in files]
    assert max(map(sum, sizes)) < 130_000 and sum(map(len, sizes)) == 180
    got = warc.assemble(warc.read(spark, f"{tmp_path}/out")).withColumn("page", warc.page_id(F.col("metadata"))).collect()
    assert sorted(r["page"] for r in got) == list(range(60)) and sum(r["record_type"] == "revisit" for r in got) == 3


def test_broken_archives():
    good = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [bytes(b) for _, b in warc.parse(good * 2)] == [b"abc"] * 2
    assert [bytes(b) for _, b in warc.parse(gzip.compress(good) + gzip.compress(good))] == [b"abc"] * 2
    for bad in (good[:-6], b"junk", good + b"junk", good.replace(b"3", b"x")):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE) - {"op1_mixing", "op4_substring", "op8_minhash", "op11_secrets", "op13_repair"}))
def test_same_rows_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    got = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(con.execute(f"select {', '.join(cols)} from ({queries.ORACLE[name]})").fetchall(), key=repr)


def test_digest_of_a_turn(spark, sf_dir):
    row = queries.QUERIES["op3_chat"](spark, sf_dir).where("conv_id = -7").first()
    text = r"\### Assistant: </turn> ok"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest() and row["loss_chars"] == len(text)


def test_long_pages_set_no_other_archives(spark, tmp_path):
    """Archives by size class: one page of 6 MB does not cut up those of sixty of 46 kB."""
    rng = np.random.default_rng(1)
    page = lambda n: rng.bytes(n // 2).hex()
    rows = [(i, f"u{i}", page(46_000)) for i in range(60)] + [(60, "u", page(6_000_000)), (61, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write(pages, f"{tmp_path}/w", records_per_file=6000, file_bytes=1 << 28)
    files = [n for n in os.listdir(f"{tmp_path}/w") if n.endswith(".gz")]
    assert len(files) == 3
    got = warc.read(spark, f"{tmp_path}/w").where("record_type = 'response'").collect()
    assert sorted(r["payload_bytes"] for r in got) == [0] + [46_000] * 60 + [6_000_000]


def test_archives_are_unpacked_as_they_are_read():
    record = lambda n: b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, b"x" * n)
    sizes = [0, 5, 3_000_000, 1, 70_000]
    for archive in (b"".join(map(record, sizes)), gzip.compress(b"".join(map(record, sizes))), b"".join(gzip.compress(record(n)) for n in sizes)):
        assert [(len(b), h["content-length"]) for h, b in warc.parse(archive)] == [(n, str(n)) for n in sizes]
    for bad in (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", record(5)[:-6], b"nonsense", record(1) + b"GET / \r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


@pytest.mark.parametrize("size", [100, 128, 129, 300, 2000])
def test_chat_sql_with_long_system_turns(spark, tmp_path, size):
    rng = random.Random(size)
    words = lambda n: " ".join(rng.choice(["a", "bc", "<|", "\\"]) for _ in range(n))
    rows = [(c, t, "system" if t == 0 else ("user", "assistant")[t % 2 - 1], words(size if t == 0 else rng.randint(0, 200))) for c in range(4) for t in range(12)]
    spark.createDataFrame(rows, TURNS).coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    got = queries.QUERIES["op3_chat"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLE['op3_chat']})").fetchall())
