"""Operators on documents against brute force, and on odd rows."""

import collections
import hashlib
import math
import os
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grainfield.llm import katz, langid, minhash, mixing, packing, queries, substring
from grainfield.llm.common import Words, pack, slide, steps, unpack, written
from grainfield.llm.components import connected_components, join_roots

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def make_docs(n=120, seed=3):
    """Texts with exact copies, near copies, shared passages, odd white space, nulls and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeÄßé") for _ in range(rng.randint(1, 5)))
    vocabulary = [word() for _ in range(300)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(n):
        kind = i % 6
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 2, 5, 60, 200]))]
        if kind == 1:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage[rng.randint(0, 15) :]
        if kind == 2:
            words = list(base)
            for _ in range(rng.randint(0, 12)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if kind == 3:
            words = words + words[: len(words) // 2]
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t ", "\x0b"]) for w in words)
        rows.append((i, text.upper() if i % 11 == 0 else text, rng.choice(["en", "de", None]), rng.choice(["a", "b", None, "", "ü"]), len(text)))
    rows += [(n, None, "en", "a", None), (n + 1, "", "de", "b", 0), (n + 2, " \t\n", None, None, 3), (n + 3, rows[2][1], "en", "a", 1), (n + 4, "123 !? 45", "en", "a", 9)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def odd(spark):
    """Null ids, repeated rows, ids that repeat with other texts, and columns with clashing names."""
    rows = [(None, "a b c", "en", "s", 1), (None, None, None, None, None), (1, "a b c", "en", "s", 1), (1, "a b c", "en", "s", 1), (1, "x y", "en", None, 1), (2, "w " * 3000, "de", "s", 1), (3, "a b c", "de", "t", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("rep", "size", "taken", "copies", "score", "lang_pred", "piece", "length", "node", "u", "kind", "marks", "bucket", "rank", "early"):
        df = df.withColumn(name, F.lit("x"))
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return (text or "").encode().split()


def test_words(rows):
    texts = pa.array([r[1] for r in rows])
    for first, part in steps(texts):
        w = Words(part)
        for i in range(len(part)):
            own = [bytes(w.data[a:b]) for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])]
            assert own == words_of(rows[first + i][1])
        by = collections.defaultdict(set)
        for a, b, h in zip(w.starts, w.ends, w.hash):
            by[bytes(w.data[a:b])].add(int(h))
        assert all(len(v) == 1 for v in by.values()) and len({h for v in by.values() for h in v}) == len(by)
    a = np.random.default_rng(0).integers(0, 99, 57)
    assert slide(a, 7, np.minimum).tolist() == [a[i : i + 7].min() for i in range(51)]
    assert unpack(pack(a)).tolist() == a.tolist() and unpack(pack(np.array([0.5, -2])), np.float64).tolist() == [0.5, -2]


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 420)] + [(500, 500)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = join_roots(np.arange(600), *map(np.array, zip(*edges)))
    want = {x: int(parent[x]) for e in edges if e[0] != e[1] for x in e}
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_mixing(spark, docs, rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
    plan = {r["_mix_key"]: r for r in mixing.plan(mixing.sized(docs))[0].collect()}
    got = mixing.mix(docs).groupBy("doc_id").count().collect()
    taken = collections.Counter()
    for r in got:
        assert r["count"] <= 2
        taken[rows[r["doc_id"]][3]] += r["count"] * len(words_of(rows[r["doc_id"]][1]))
    goal = {k: plan["-" if k is None else "=" + k]["_mix_target"] for k in sizes}
    assert sum(goal.values()) == pytest.approx(1.5 * sum(sizes.values()))
    order = sorted(k for k in sizes if k is not None) + [None]
    weight = {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
    free = [k for k in sizes if goal[k] < 2 * sizes[k] - 1e-6]
    assert len({round(goal[k] / weight[k], 6) for k in free}) <= 1
    assert all(abs(taken[k] - goal[k]) <= max(len(words_of(r[1])) for r in rows if r[3] == k) for k in sizes)
    small, large = ({r["doc_id"] for r in mixing.mix(docs, budget_share=b, max_epochs=1).collect()} for b in (0.2, 0.4))
    assert small < large
    assert mixing.mix(empty(spark)).count() == 0
    out = mixing.mix(odd(spark))
    assert out.columns == odd(spark).columns and out.where("doc_id = 2").count() in (1, 2)


def test_mixing_never_above_the_limit(spark):
    """Empty and null texts too come twice at most, whatever their hash, where a source's target is a whole number of its sizes."""
    rows = [(i, ["", None, " "][i % 3] if i % 2 else "w " * (i % 7 + 1), "en", "ab"[i % 2 and i % 4 == 1], 1) for i in range(600)]
    rows += [(1000 + i, None, "en", "c", 1) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    for share, epochs in ((1.5, 2), (2.0, 2), (1.0, 1), (3.0, 3), (9.0, 2)):
        counts = [r["count"] for r in mixing.mix(df, budget_share=share, max_epochs=epochs).groupBy("doc_id").count().collect()]
        assert max(counts) <= epochs


def near(rows, k):
    """Smallest linked id of every document, by brute force."""
    sets = {}
    for r in rows:
        w = (r[1] or "").encode().translate(LOWER).split()
        sets[r[0]] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    ids = list(sets)
    pairs = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    parent = join_roots(np.arange(max(ids) + 1), *(np.array(c, np.int64) for c in (zip(*pairs) if pairs else ([], []))))
    return sets, {i: int(parent[i]) for i in ids}


@pytest.mark.parametrize("k", [2, 5])
def test_minhash(docs, rows, k):
    sets, want = near(rows, k)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs, minhash.Settings(words=k)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())
    assert len({*want.values()}) < len(want) - 5


@pytest.mark.parametrize("more", [{"TILE": 3}, {"SHINGLES": 200}, {"TILE": 2, "SHINGLES": 50}])
def test_minhash_in_many_tiles(spark, docs, rows, monkeypatch, more):
    for name, value in more.items():
        monkeypatch.setattr(minhash, name, value)
    _, want = near(rows, 2)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, minhash.Settings(words=2)).collect()} == want


def test_minhash_odd_rows(spark):
    got = minhash.near_duplicates(odd(spark)).collect()
    assert len(got) == 7 and {r["component_id"] for r in got if r["doc_id"] == 3} == {1}
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    left = minhash.dedup(odd(spark))
    assert left.columns == odd(spark).columns
    # of id 1 the text that others copy and the other one, each once; id 3 is a copy
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect() if r["doc_id"] is not None)) == [(1, "a b c"), (1, "x y"), (2, "w " * 3000)]
    assert left.where("doc_id is null").count() == 2
    shared = [(1, "p q r s t u v"), (5, "p q r s t u v"), (5, "its own words here they are"), (5, "its own words here they are"), (6, "p q r s t u v"), (7, ""), (7, None), (7, "")]
    kept = minhash.dedup(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in shared], SCHEMA)).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in kept)[:2] == [(1, "p q r s t u v"), (5, "its own words here they are")] and {r["doc_id"] for r in kept} == {1, 5, 7}
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_sketch_coordinates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 62, 100).astype(np.uint64)])
    s = minhash.sketches(np.concatenate([a, b, a[:1]]), np.array([0, 400, 800, 801]), 512)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.1 and (s != minhash._EMPTY).all()


def repeats(rows, window):
    first, out = {}, {}
    for r in sorted(rows, key=lambda r: r[0]):
        w = words_of(r[1])
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if first.setdefault(tuple(w[p : p + window]), r[0]) < r[0]:
                gone[p : p + window] = [True] * window
        out[r[0]] = (len(w), sum(gone), [x for x, g in zip(w, gone) if not g])
    return out


@pytest.mark.parametrize("window", [20, 50])
def test_substring(docs, rows, window):
    want = repeats(rows, window)
    got = {r["doc_id"]: r for r in substring.repeats(docs, window).collect()}
    for i, (n, gone, kept) in want.items():
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, gone, hashlib.sha256(b" ".join(kept)).hexdigest())
    assert sum(w[1] for w in want.values()) > 500
    left = {r["doc_id"]: r for r in substring.remove_repeats(docs, window).collect()}
    for i, (_, gone, kept) in want.items():
        assert words_of(left[i]["text"]) == kept
        if not gone:
            assert left[i]["text"] == rows[i][1] if i < 120 else True
        elif left[i]["n_chars"] is not None:
            assert left[i]["n_chars"] == len(left[i]["text"])


def test_substring_odd_rows(spark):
    got = substring.repeats(odd(spark)).collect()
    assert len(got) == 7 and all(r["n_removed"] == 0 for r in got)
    out = substring.remove_repeats(odd(spark))
    assert out.count() == 7 and out.columns == odd(spark).columns
    assert substring.repeats(empty(spark)).count() == 0
    twice = [(i, "the same words again " * 40, "en", "s", 1) for i in (None, 7, 7, 8)]
    gone = {(r["doc_id"], r["n_removed"]) for r in substring.repeats(spark.createDataFrame(twice, SCHEMA)).collect()}
    assert gone == {(None, 0), (7, 0), (8, 160)}


def katz_by_hand(texts, train, order):
    """Log probabilities of token lists by the recursion as written, with dictionaries; texts: {id: tokens}."""
    begin, k = "begin", katz.K
    padded = [[begin] * (order - 1) + t for t in train]
    grams = {j: collections.Counter(tuple(t[i - j + 1 : i + 1]) for t in padded for i in range(order - 1, len(t))) for j in range(1, order + 1)}
    past = {j: collections.Counter(tuple(t[i - j + 1 : i]) for t in padded for i in range(order - 1, len(t))) for j in range(2, order + 1)}
    d = {j: katz.discounts([collections.Counter(g.values())[r] for r in range(1, k + 2)]) for j, g in grams.items()}
    total = sum(grams[1].values())
    p1 = {g: d[1][c - 1] * c / total if c <= k else c / (total + 1) for g, c in grams[1].items()}
    unknown = 1 - math.fsum(p1.values())
    after = {j: collections.defaultdict(list) for j in grams}
    for j in range(2, order + 1):
        for g in grams[j]:
            after[j][g[:-1]].append(g)
    found, weights = {}, {}

    def prob(g):
        if len(g) == 1:
            return p1.get(g, unknown)
        if g not in found:
            c, m, h = grams[len(g)].get(g, 0), past[len(g)].get(g[:-1], 0), g[:-1]
            if c:
                found[g] = d[len(g)][c - 1] * c / m if c <= k else c / (m + 1)
            elif not m:
                found[g] = prob(g[1:])
            else:
                if h not in weights:
                    weights[h] = (1 - math.fsum(prob(x) for x in after[len(g)][h])) / (1 - math.fsum(prob(x[1:]) for x in after[len(g)][h]))
                found[g] = weights[h] * prob(g[1:])
        return found[g]

    for h in list(past[order])[:10]:  # every history's probabilities sum to 1
        assert math.fsum(prob((*h, *w)) for w in grams[1]) + prob((*h, "no such word")) == pytest.approx(1)
    out = {}
    for i, t in texts.items():
        own = [begin] * (order - 1) + t
        out[i] = sum(math.log10(prob(tuple(own[j - order + 1 : j + 1]))) for j in range(order - 1, len(own)))
    return out, grams[1], total


@pytest.mark.parametrize(("order", "more"), [(2, {}), (3, {}), (4, {}), (2, {"tokens": 500, "least": 5}), (3, {"tokens": 700, "least": 3, "block": 20_000}), (4, {"tokens": 900, "least": 1, "block": 9000})])
def test_katz(docs, rows, order, more):
    """Brute force; with few tokens a partition and a low bound, histories of every length are hot."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    got = {r["doc_id"]: r for r in katz.score(docs, fold != 2, fold == 2, katz.Settings(order=order, **more)).collect()}
    texts = {r[0]: (r[1] or "").encode().translate(LOWER).split() + [None] for r in rows}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    want, one, total = katz_by_hand(texts, [t for i, t in texts.items() if not out[i]], order)
    for i, t in texts.items():
        assert got[i]["score"] == pytest.approx(want[i], rel=1e-9) and got[i]["n_tokens"] == len(t) and got[i]["held_out"] == out[i]
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((one[w,] + 1) / (total + len(one) + 1)) for w in t))
        assert got[i]["n_known"] == sum((w,) in one for w in t) and got[i]["train_tokens"] == total


def test_katz_repeated_files_and_rows(spark, docs, rows):
    """Equal blocks in several tasks, and blocks of null rows, count each."""
    twice = docs.union(docs).union(spark.createDataFrame([(None, None, None, None, None)] * 6, SCHEMA).repartition(3))
    got = katz.score(twice, F.col("doc_id").isNotNull(), F.lit(False)).collect()
    texts = {r[0]: (r[1] or "").encode().translate(LOWER).split() + [None] for r in rows}
    want, _, total = katz_by_hand({**texts, None: [None]}, [*texts.values(), *texts.values()], 3)
    assert collections.Counter(r["doc_id"] for r in got) == {**dict.fromkeys(texts, 2), None: 6}
    assert all(r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-9) and r["train_tokens"] == total for r in got)


def test_katz_tells_repeated_texts_apart(spark):
    """A text that others repeat is likelier by trigrams than by bigrams, word by word."""
    rng = random.Random(8)
    line = lambda: " ".join(f"w{rng.randrange(40)}" for _ in range(60))
    seen = [line() for _ in range(20)]
    texts = [x for i, t in enumerate(seen) for x in [t] * (1 + i % 4)] + [line() for _ in range(20)]
    n = len(texts)
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts + seen + [line() for _ in range(20)])]
    df = spark.createDataFrame(rows, SCHEMA)
    gain = {k: {r["doc_id"]: r["score"] - r["base_score"] for r in katz.score(df, F.col("doc_id") < n, F.col("doc_id") >= n, katz.Settings(order=k)).collect()} for k in (2, 3)}
    mean = lambda g, a: sum(g[i] for i in range(a, a + 20)) / 20
    assert mean(gain[3], n) > mean(gain[3], n + 20) + 20
    assert mean(gain[3], n) > mean(gain[2], n)


def test_katz_registered_query(spark, sf_dir):
    """The query on its table: scores against dictionaries, the exact columns against SQL."""
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    tokens = {i: (t or "").encode().translate(LOWER).split() + [None] for i, t in texts.items()}
    want, _, total = katz_by_hand(tokens, [t for i, t in tokens.items() if not held[i]], 3)
    got = {r["doc_id"]: r for r in queries.QUERIES["op6_katz"](spark, sf_dir).collect()}
    assert set(got) == set(texts) and all(got[i]["score"] == pytest.approx(want[i], rel=1e-9) and got[i]["held_out"] == held[i] for i in texts)
    con = duckdb.connect()
    con.execute("create table held as select * from (values " + ", ".join(f"({i}, {h})" for i, h in held.items()) + ") as h(doc_id, held_out)")
    base = con.execute(rf"""
WITH t AS (SELECT doc_id, held_out, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+'), chr(10))) AS w
  FROM read_parquet('{sf_dir}/documents.parquet') JOIN held USING (doc_id)),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, count(*), count(c), any_value(n)::BIGINT, sum(log10((coalesce(c, 0) + 1) / (n + v + 1))) FROM t LEFT JOIN c USING (w), n GROUP BY doc_id""").fetchall()
    assert len(base) == len(texts)
    for i, size, known, n, score in base:
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (size, known, n) and n == total and got[i]["base_score"] == pytest.approx(score, rel=1e-12)


@pytest.mark.parametrize("n", [[207344, 59772, 25017, 14274, 13493, 7080], [1579638, 246704, 51653, 21705, 18939, 7580], [900, 300, 0, 80, 60, 41], [30, 0, 4, 0, 0, 0]])
def test_katz_irregular_counts_of_counts(n):
    """Discounts stay those of Good-Turing: (r + 1) n(r + 1) / (r n(r)) of a falling line, less the share of counts above K."""
    k, r = katz.K, np.arange(1, katz.K + 1)
    x = [i + 1 for i in range(k + 1) if n[i]]
    z = [n[i - 1] / (((x[j + 1] if j + 1 < len(x) else 2 * i - x[j - 1]) - (x[j - 1] if j else 0)) / 2) for j, i in enumerate(x)]
    lx, ly = np.log(x), np.log(z)
    slope = ((lx - lx.mean()) * (ly - ly.mean())).sum() / ((lx - lx.mean()) ** 2).sum()
    a = (k + 1) ** (1 + slope)
    assert slope < -1 and katz.discounts(n) == pytest.approx(((1 + 1 / r) ** (1 + slope) - a) / (1 - a))
    regular = [1000, 300, 140, 80, 52, 36]
    c = np.array(regular, float)
    assert katz.discounts(regular) == pytest.approx(((r + 1) * c[1:] / (r * c[:-1]) - 0.216) / (1 - 0.216))


def test_katz_hot_histories(spark):
    """A history with half of all tokens is dealt by more words, and scores stay the same."""
    rng = random.Random(5)
    rows = [(i, " ".join(w for _ in range(60) for w in ("the", rng.choice("abcdefgh") * rng.randint(1, 9))), "en", "s", 1) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    fold = F.col("doc_id") % 5
    get = lambda **s: {r["doc_id"]: r["score"] for r in katz.score(df, fold != 0, fold == 0, katz.Settings(**s)).collect()}
    assert get(tokens=400, least=20) == pytest.approx(get(), rel=1e-9)


def test_katz_odd_rows(spark):
    got = katz.op6_katz.__globals__["score"](odd(spark), F.col("doc_id").isNotNull(), F.lit(None).cast("boolean")).collect()
    assert len(got) == 7 and all(math.isfinite(r["score"]) for r in got)
    none = katz.score(odd(spark), F.lit(False), F.lit(True)).collect()
    assert {r["score"] for r in none} == {0.0} and all(r["held_out"] for r in none)
    assert katz.score(empty(spark), F.lit(True), F.lit(False)).count() == 0


@pytest.mark.parametrize("size", [16, 64, 1024])
def test_best_fit_plan(size):
    rng = random.Random(size)
    for _ in range(20):
        counts = {n: rng.randint(1, 200) for n in rng.sample(range(1, size + 1), rng.randint(1, min(size, 60)))}
        used, filled = collections.Counter(), collections.defaultdict(list)
        for length, rank, n, first, offset, each in packing.best_fit(counts, size).tolist():
            assert rank == used[length]
            used[length] += n * each
            for i in range(n):
                filled[first + i] += [(offset + j * length, length) for j in range(each)]
        assert used == counts
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= size
        free, bins = [], 0
        for length in sorted(counts, reverse=True):
            for _ in range(counts[length]):
                fit = min((f for f in free if f >= length), default=None)
                if fit is None:
                    bins += 1
                    fit = size
                else:
                    free.remove(fit)
                free.append(fit - length)
        assert len(filled) == bins


def packed_by_hand(rows, got, size):
    """Holds packed pieces against the unmodified tokenizer and the rules of cutting and placing; rows: (doc_id, text), ids may repeat."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    want, lengths = collections.Counter(), collections.Counter()
    for i, text in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        first = (len(ids) - 1) % size + 1
        cuts = [(0, first), *((a, size) for a in range(first, len(ids), size))]
        for k, (start, length) in enumerate(cuts):
            want[i, k, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
            lengths[length] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    spans = collections.defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    free, bins = [], 0  # best fit decreasing, piece by piece
    for length in sorted(lengths.elements(), reverse=True):
        room = min((f for f in free if f >= length), default=None)
        if room is None:
            bins, room = bins + 1, size
        else:
            free.remove(room)
        free.append(room - length)
    assert len(spans) == bins


@pytest.mark.parametrize("size", [64, 1024])
def test_packing(docs, rows, size):
    got = packing.pack_documents(docs, size=size).collect()
    packed_by_hand([(r[0], r[1]) for r in rows], got, size)
    cut = packing.pieces(docs, packing.tokenizer_path(), size, with_ids=True).cache()
    whole = packing.sequences(packing.pack(cut, size)).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in got)


def test_op9_by_hand(spark, sf_dir):
    """The registered query on its whole table."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    packed_by_hand([tuple(r) for r in rows], packing.op9_packing(spark, sf_dir).collect(), 1024)


def test_tokenizer_is_the_same():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    enc, added, rng = packing.byte_bpe(packing.tokenizer_path()), packing.added_tokens(packing.tokenizer_path()), random.Random(2)
    texts = ["", "<|endoftext|> a", "don't 'S I'll", "a\x1c \x1db", "日本語 ①²½ \U0001f600", "".join(map(chr, range(1, 0x2000)))]
    texts += ["".join(chr(rng.choice([rng.randint(1, 126), rng.randint(1, 0xD7FF), 32, 10])) for _ in range(200)) for _ in range(200)]
    assert all(tok.encode(t, add_special_tokens=False).ids == packing.token_ids(enc, t, added).tolist() for t in texts)


def test_packing_long_white_space(spark):
    """Runs above a million characters, and at the limit from which they are cut out, give the ids of ``tokenizers``."""
    from tokenizers import Tokenizer

    tok, n = Tokenizer.from_file(packing.tokenizer_path()), packing.RUN
    texts = ["a" + " " * 1_000_001 + "word", " \n" * 700_000 + "x"]
    texts += [a + w * k + b for a in ("", "it's", "1\x1c") for b in ("", "b", "9", "!", "\x1d", "\n") for w in (" ", "\u3000", "\x85") for k in (n - 1, n, n + 1)]
    texts += [" " * n + "a" + "\t" * n + "b" + " " * (n + 5), " " * n + "\x1c" + " " * n]
    enc = packing.byte_bpe(packing.tokenizer_path())
    assert all(tok.encode(t, add_special_tokens=False).ids == packing.token_ids(enc, t).tolist() for t in texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts[:2])], SCHEMA)
    got = packing.pack_documents(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts[:2])}


def test_added_tokens_have_their_ids(spark):
    """The unmodified tokenizer's ids for texts that hold an added token."""
    from tokenizers import Tokenizer

    tok, path = Tokenizer.from_file(packing.tokenizer_path()), packing.tokenizer_path()
    ids = lambda t: tok.encode(t, add_special_tokens=False).ids
    e = "<|endoftext|>"
    texts = ["end <|endoftext|> next", e, e + e, f"a{e}b", f" {e}  {e}\n\n{e} ", f"<|{e}|>", "<|endoftext|", f"it{e}'s", f"x  {e}  y", e[:-1] + e, f"{e}\x1c{e}", f" \t{e}" * 50 + " " * 120_000 + e]
    enc, rng = packing.byte_bpe(path), random.Random(9)
    texts += ["".join(rng.choice([e, " ", "\n", "a", "ä", "7", "<|", "|>", "'s", "\u3000"]) for _ in range(40)) for _ in range(200)]
    assert len(ids(texts[0])) == 4 and all(ids(t) == packing.token_ids(enc, t, packing.added_tokens(path)).tolist() for t in texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts[:11])], SCHEMA)
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack_documents(docs).collect()}
    assert got == {i: (len(ids(t)) + 1, zlib.crc32(np.array([*ids(t), 2], "<u4").tobytes())) for i, t in enumerate(texts[:11])}


def test_packing_odd_rows(spark):
    got = packing.pack_documents(odd(spark))
    assert got.groupBy("doc_id", "piece").count().count() >= 4 and got.where("doc_id is null").count() == 2
    assert got.agg(F.max("length")).first()[0] == 1024
    assert packing.pack_documents(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(got.select("doc_id", "piece", "start", "length"), 8)


def test_langid_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = langid.op10_langid(spark, sf_dir).join(docs, "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_langid_by_hand(spark, sf_dir):
    """The registered query against sets of n-grams and masks made one by one."""
    s = langid.Settings()
    low = (1 << 64) - 1

    def slots(gram):
        x = int.from_bytes(gram, "little") | len(gram) << 60
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ x >> shift) * factor & low
        x ^= x >> 31
        return [x >> i * s.bits & (1 << s.bits) - 1 for i in range(s.hashes)]

    def grams(text):
        letter = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in text.encode().translate(LOWER))
        out = []
        for word in letter.split(b" "):
            own = b" " + word + b" " if word else b""
            out += [own[i : i + n] for n in s.sizes for i in range(len(own) - n + 1)]
        return out

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None and r["text"] is not None:
            counts[r["lang"]].update(grams(r["text"]))
    filters = {}
    for lang, c in counts.items():
        total = collections.Counter()
        for g, n in c.items():
            total[len(g)] += n
        twice = collections.Counter(len(g) for g, n in c.items() if n > 1)
        filters[lang] = {x for g, n in c.items() if n >= max(2 if twice[len(g)] >= s.few else 1, s.share * total[len(g)]) for x in slots(g)}
    rate = {lang: (len(f) / (1 << s.bits)) ** s.hashes for lang, f in filters.items()}
    got = {r["doc_id"]: r for r in langid.op10_langid(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        own, text = got[r["doc_id"]], r["text"]
        assert own["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if text is None or not any(c.isalpha() for c in text):
            assert (own["lang_pred"], own["score"]) == ("und", 0)
            continue
        found = grams(text)
        places = [slots(g) for g in found]
        true = {lang: max(0, sum(all(x in f for x in p) for p in places) - len(found) * rate[lang]) / (1 - rate[lang]) for lang, f in filters.items()}
        best = max(sorted(true), key=lambda k: true[k])
        assert own["lang_pred"] == best or true[own["lang_pred"]] == pytest.approx(true[best], rel=1e-12)
        assert own["score"] == pytest.approx(true[best] / max(sum(true.values()), 1e-300))


def test_langid_shortest_words(spark):
    """A text of one word of two letters has n-grams: those with the spaces around it."""
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("zu zu zu ab", "de"), ("of of of by", "en")] * 3)]
    model = langid.train(spark.createDataFrame(rows, SCHEMA))
    asked = spark.createDataFrame([(0, "of", None, None, 1), (1, "zu", None, None, 1), (2, "ZU!", None, None, 1)], SCHEMA)
    got = {r["doc_id"]: r for r in langid.identify(asked, model).collect()}
    assert [got[i]["lang_pred"] for i in range(3)] == ["en", "de", "de"] and all(r["score"] > 0.9 for r in got.values())


def test_langid_small_samples(spark):
    """Languages in which no n-gram occurs twice are learned, beside others in which some do."""
    asked = spark.createDataFrame([(0, "hello", None, None, 1), (1, "guten", None, None, 1), (2, "xyz", None, None, 1), (3, "12 3", None, None, 1)], SCHEMA)
    for text in ("hello world", "hello hello"):
        model = langid.train(spark.createDataFrame([(1, text, "en", "s", 1), (2, "guten tag", "de", "s", 1), (3, "7", "fr", "s", 1)], SCHEMA).withColumn("_rows", F.lit(1)))
        assert model.languages == ("de", "en")
        got = [r["lang_pred"] for r in langid.identify(asked, model).orderBy("doc_id").collect()]
        assert got[:2] == ["en", "de"] and got[2] in model.languages and got[3] == "und"
    nothing = langid.identify(asked, langid.train(asked)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_langid_many_languages(spark):
    """More languages than one 64-bit slot holds."""
    rng = random.Random(4)
    alphabets = [rng.sample("abcdefghijklmnopqrstuvwxyz", 6) for _ in range(80)]
    text = lambda a: " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(150))
    rows = [(i, text(alphabets[i % 80]), f"l{i % 80:02}", "s", 1) for i in range(240)]
    df = spark.createDataFrame(rows, SCHEMA)
    model = langid.train(df.where("doc_id < 160"), langid.Settings(share=1e-4))
    assert model.slots.shape[0] == 2
    got = langid.identify(df.where("doc_id >= 160"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 76


def test_langid_odd_rows(spark):
    df = odd(spark).union(spark.createDataFrame([(9, "123 !?", "en", "s", 1), (10, "", "en", "s", 1), (11, "日本", "en", "s", 1), (12, "hello there hello there", "en", "s", 1)], SCHEMA).select("*", *[F.lit("x").alias(c) for c in odd(spark).columns[5:]]))
    model = langid.train(df.select("doc_id", "text", "lang"))
    with pytest.raises(ValueError):
        langid.identify(df, model)
    names = ("_a", "_b")
    got = {r["doc_id"]: {"lang_pred": r["_a"], "score": r["_b"]} for r in langid.identify(df, model, names).collect()}
    assert got[9]["lang_pred"] == got[10]["lang_pred"] == "und" and got[11]["lang_pred"] != "und"
    blank = langid.train(empty(spark))
    assert {r["_a"] for r in langid.identify(df, blank, names).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0


CLASHING = ("score", "lang_pred", "kept", "piece", "length", "component_id", "n_words", "offset", "rank", "_c0")


@pytest.mark.parametrize("clash", [False, True])
def test_pipeline_stages(spark, docs, rows, tmp_path, clash):
    """Every stage against brute force on what its predecessor kept; columns of any name come through untouched."""
    frame = docs
    for name in CLASHING if clash else ():
        frame = frame.withColumn(name, F.concat(F.lit(f"{name} "), F.col("doc_id").cast("string")))
    columns = frame.columns
    state = {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, frame = frame, spark.read.parquet(f"{tmp_path}/{name}")
        had = [tuple(r)[:5] for r in before.select(*SCHEMA.replace(" long", "").replace(" string", "").split(", ")).collect()]
        now = {r["doc_id"]: r for r in frame.collect()}
        if name == "language_id":
            assert set(now) == {i for i, r in state.items() if r[1] and any(c.isalpha() for c in r[1])}
        if name == "near_duplicates":
            _, want = near(had, 5)
            assert set(now) == set(want.values())
        if name == "repeated_passages":
            want = repeats(had, 50)
            assert {i: words_of(r["text"]) for i, r in now.items()} == {i: w[2] for i, w in want.items()}
        if name == "source_mix":
            counts = collections.Counter(r["doc_id"] for r in frame.collect())
            assert max(counts.values()) <= 2 and set(counts) <= {r[0] for r in had}
            sizes = collections.Counter()
            for r in had:
                sizes[r[3]] += len(words_of(r[1]))
            order = [*sorted(k for k in sizes if k is not None), *([None] if None in sizes else [])]
            goal, left, weight = {}, 1.5 * sum(sizes.values()), {k: (3, 1, 2)[i % 3] for i, k in enumerate(order)}
            while True:  # what is above a source's bound is shared again by weight
                free = [k for k in order if k not in goal]
                full = [k for k in free if left * weight[k] / sum(weight[x] for x in free) >= 2 * sizes[k]]
                goal |= {k: 2 * sizes[k] for k in full} if full else {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
                left -= sum(2 * sizes[k] for k in full)
                if not full or len(goal) == len(order):
                    break
            for k in order:
                took = sum(counts[r[0]] * len(words_of(r[1])) for r in had if r[3] == k)
                assert abs(took - goal[k]) <= max(len(words_of(r[1])) for r in had if r[3] == k)
        if name == "packed":
            packed_by_hand([(r[0], r[1]) for r in had], frame.collect(), 1024)
        else:
            assert frame.columns == columns
            assert not clash or all(r[c] == f"{c} {i}" for i, r in now.items() for c in CLASHING)


def test_pipeline_leaves_no_scratch(spark, sf_dir):
    """Only the tables of the stages themselves, and of the last stage, are left in the shared folder."""
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert not [x for x in os.listdir(base) if "-scratch-" in x]


@pytest.mark.parametrize("name", ["op1_mixing", "op4_substring", "op8_minhash"])
def test_oracles_of_documents(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    got = queries.QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(con.execute(f"select {', '.join(cols)} from ({queries.ORACLE[name]})").fetchall())


def test_packing_deals_equal_ids(spark):
    """Rows without an id, and repeats of one, are dealt to many groups, and all is packed."""
    n = 3000
    cut = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit(5)).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(300).alias("length"), F.col("id").alias("_pack_row"))
    cut = written(cut, "cut")
    assert cut.select(F.pmod(F.xxhash64("_pack_row"), F.lit(64))).distinct().count() == 64
    got = packing.pack(cut).collect()
    assert "_pack_row" not in got[0] and len(got) == n
    spans = collections.defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append(r["offset"])
    assert len(spans) == n // 3 and all(sorted(s) == [0, 300, 600] for s in spans.values())
