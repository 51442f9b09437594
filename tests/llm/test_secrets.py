"""Secret scans against windows taken one by one, against SQL, and on odd texts."""

import collections
import hashlib
import math
import random
import re
import string

import duckdb
import pytest

from grainfield.llm import queries, secret_scan

S = secret_scan.Settings()
SCHEMA = "doc_id long, text string, spans string"
# the base patterns, either case by a flag
BASE = {"assign": (r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), "access": ("AKIA[A-Z0-9]+", 0, 20), "hex": ("[0-9a-f]+", 0, 24)}


def brute(text):
    """All spans of a text; entropies of windows from scratch, in floats."""
    base = [(k, *m.span()) for k, (p, g, n) in BASE.items() for m in re.finditer(p, text) if len(m[g]) >= n]
    found = []
    for c in S.classes:
        cover = set()
        for a in range(len(text) - c.window + 1):
            w = text[a : a + c.window]
            if not re.fullmatch(f"[{c.alphabet}]+", w):
                continue
            h = -sum(n / len(w) * math.log2(n / len(w)) for n in collections.Counter(w).values())
            up, low, dig = sum(x in string.ascii_uppercase for x in w), sum(x in string.ascii_lowercase for x in w), sum(x in string.digits for x in w)
            if h >= c.bits and dig >= c.digits and up >= c.upper and low >= c.lower and up + low >= c.letters:
                cover.add(a)
        at = None
        for a in sorted(cover):
            if at and a <= at[1]:
                at[1] = a + c.window
            else:
                at = [a, a + c.window]
                found.append((c.name, at))
    found = [(k, *x) for k, x in found if not any(re.search(p, text[x[0] : x[1]]) for p in S.allow)]
    names = [*BASE, *(c.name for c in S.classes)]
    inside = lambda x, y: y[1] <= x[1] and y[2] >= x[2]
    kept = [x for x in found if not any(inside(x, y) for y in base) and not any(inside(x, y) and y[0] != x[0] and (y[1:] != x[1:] or names.index(y[0]) < names.index(x[0])) for y in found)]
    order = lambda x: (x[1], names.index(x[0]))
    return sorted(base, key=order), sorted(base + kept, key=order)


def made(seed=1, n=250):
    rng = random.Random(seed)
    b64, hexa = string.ascii_letters + string.digits + "+/_-", "0123456789abcdef"
    one = {
        "word": lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 30))),
        "b64": lambda: "".join(rng.choice(b64) for _ in range(rng.randint(18, 60))),
        "alnum": lambda: "".join(rng.choice(string.ascii_lowercase + string.digits) for _ in range(rng.randint(18, 45))),
        "hex": lambda: "".join(rng.choice(hexa) for _ in range(rng.randint(18, 45))),
        "HEX": lambda: "".join(rng.choice(hexa.upper()) for _ in range(rng.randint(18, 45))),
        "key": lambda: "AKIA" + "".join(rng.choice(string.ascii_uppercase + string.digits) for _ in range(rng.randint(10, 25))),
        "set": lambda: rng.choice(["password", "PassWd", "api_key", "APIKEY", "my_secret", "ToKeN", "ſecret", "toKen"]) + rng.choice(["", '"', "'"]) + rng.choice(["=", ": ", "  =  ", " =\t", "=="]) + rng.choice(['"', "'", ""]) + rng.choice(["hunter2", "abc", "x" * 40, "a.b-c/d=", "über99999"]),
        "allowed": lambda: rng.choice(["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "EXAMPLEkey7MDENGbPxRfiCYq9Z2", "iVBORw0KGgoAAAANSUhEUgAA9sT4qZ7"]),
        "odd": lambda: rng.choice(["äöü", "日本語", "🙂", "0" * 50, "-" * 30, "ab" * 20, "a1B2" * 12]),
    }
    return ["".join(one[rng.choice(list(one))]() + rng.choice([" ", "\n", ",", "ß", ""]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    long = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(5000))
    return [*enumerate(made()), (None, None), (900, ""), (901, " \n"), (902, "x " * 200_000 + "é token = 24be64439e3e49cf46b2d7c9 " + long), (3, None), (3, "passwd:secret:token=1234567890")]


def test_against_windows(spark, rows):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA).repartition(3)
    got = collections.Counter((r["doc_id"], tuple(tuple(x) for x in r["spans"])) for r in secret_scan.find_secrets(df).collect())
    assert got == collections.Counter((i, tuple(brute(t or "")[1])) for i, t in rows if i != 902) + collections.Counter((r["doc_id"], tuple(tuple(x) for x in r["spans"])) for r in secret_scan.find_secrets(df.where("doc_id = 902")).collect())
    kinds = collections.Counter(k for _, spans in got for k, _, _ in spans)
    assert len(kinds) == 6 and min(kinds.values()) > 5
    long = [tuple(x) for r in secret_scan.find_secrets(df.where("doc_id = 902")).collect() for x in r["spans"]]
    assert long[:2] == [("assign", 400_002, 400_034), ("hex", 400_010, 400_034)] and long[2][1] == 400_035 and sum(b - a for _, a, b in long[2:]) > 4000
    assert secret_scan.find_secrets(df.where("doc_id = -1")).collect() == []


def test_sql(spark, rows, tmp_path):
    df = spark.createDataFrame([(i, t, "x") for i, t in rows if i != 902], SCHEMA).repartition(2)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    out = queries.QUERIES["op11_secrets"](spark, str(tmp_path))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(con.execute(f"select {', '.join(out.columns)} from ({secret_scan.ORACLE_SQL})").fetchall(), key=repr)


def test_registered_query(spark, sf_dir):
    said = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    got = {r["doc_id"]: r for r in queries.QUERIES["op11_secrets"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(docs) == len(got)
    for r in docs:
        base, every = brute(r["text"] or "")
        own = got[r["doc_id"]]
        assert (own["n_assign"], own["n_access"], own["n_hex"]) == tuple(sum(x[0] == k for x in base) for k in BASE)
        assert own["base_sha256"] == hashlib.sha256(said(base).encode()).hexdigest() and own["spans"] == said(every)


def test_counts_do_not_drift():
    """The running sum over a long run is that of each window from scratch."""
    rng = random.Random(4)
    run = "".join(rng.choice("0123456789abcdefABCDEF" if i % 900 < 600 else "a1") for i in range(20_000))
    c = S.classes[0]
    inside = set().union(*(range(a, b) for a, b in secret_scan.flagged(run, c)))
    table = secret_scan.weights(c.window)
    want = set()
    for a in range(len(run) - c.window + 1):
        w = run[a : a + c.window]
        if sum(table[n] for n in collections.Counter(w).values()) <= c.most and sum(x.isdigit() for x in w) >= 2 and sum(x.isalpha() for x in w) >= 2:
            want |= set(range(a, a + c.window))
    assert inside == want and 0 < len(want) < len(run)
