"""Conversation repair against costs to go, against all edit strings of short conversations, against SQL, and on odd rows."""

import collections
import hashlib
import itertools
import random
import zlib

import duckdb
import pytest

from grainfield.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
BIG = 10**9


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h:
            text = "" if h == 1 else "".join(x for x in text if x not in ".!?") if h == 2 else text
            out += [(c, t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        shown = text.strip(SPACE)
        out.append("b" if not shown else "d" if (role, text) in seen else "t" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def keeps(state, initial):
    return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((state, initial))


def cheapest(rows, found):
    """Cost and audit: costs to go backwards, then the least letter that stays on a cheapest way."""
    n, ins = len(rows), (2, 2, 3, 2)

    def edits(i, s, to_go):
        """(letter, cost, row, state, cost to go) of each edit."""
        out = []
        if i < n:
            more = 3 * (found[i] == "t")
            out.append(("D", 4, i + 1, s))
            if found[i] not in ("b", "d"):
                if keeps(s, rows[i][2][:1]) is not None:
                    out.append(("K", more, i + 1, keeps(s, rows[i][2][:1])))
                out.append(("R", 3 + more, i + 1, ins[s]))
        out.append(("I", 3, i, ins[s]))
        return sorted((e, c, j, t, c + to_go[j, t]) for e, c, j, t in out)

    to_go = collections.defaultdict(lambda: BIG)
    to_go[n, 0] = to_go[n, 3] = 0
    for i in range(n, -1, -1):
        for _ in range(4):
            for s in range(4):
                to_go[i, s] = min(to_go[i, s], *(e[4] for e in edits(i, s, to_go)))
    i = s = 0
    audit = ""
    while i < n or s not in (0, 3):
        e, _, i, s, _ = next(x for x in edits(i, s, to_go) if x[4] == to_go[i, s])
        audit += e
    return to_go[0, 0], audit


def wanted(rows, damage=True):
    """Result rows by conversation."""
    by = {r[0]: [] for r in rows}
    for r in damaged(rows) if damage else [(c, t, " " if x is None else x, " " if y is None else y) for c, t, x, y in rows]:
        by[r[0]].append(r)
    out = {}
    for c, own in by.items():
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        found = faults(own)
        cost, audit = cheapest(own, found)
        turns = {r[1] for r in own} - {None}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        kept, state, it = [], 0, iter(own)
        for e in audit:
            r = None if e == "I" else next(it)
            if e == "D":
                continue
            role = r[2] if e == "K" else "assistant" if state == 2 else "user"
            kept.append(f"{role}:{'' if e == 'I' else r[3]}")
            state = {"s": 1, "u": 2, "a": 3}[role[:1]]
        count = collections.Counter(found)
        out[c] = (c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["b"], count["d"], count["t"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def made(seed, n=40, longest=12):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"])
            text = rng.choice(["Hi.", "Why?", "ok", " \n", None, "", "No!", "end. \t", "x" + str(rng.randint(0, 5)), f"Line {t}."])
            rows.append((c, rng.choice([t, t, t, t + 5, None, 1]), role, text))
    return rows + [(None, None, "user", "A."), (None, 3, None, None), (-5, -(2**62), "user", "B."), (-5, 2**62, "assistant", "C.")]


@pytest.mark.parametrize(("rows", "seed"), [(4096, 1), (2, 2), (1, 3)])
def test_repair(spark, rows, seed):
    """Whole conversations, and pieces of one and two rows."""
    data = made(seed)
    df = spark.createDataFrame([(*r, "x") for r in data], SCHEMA + ", audit string").repartition(3)
    got = {r["conv_id"]: tuple(r) for r in repair.repair(repair.damage(df), repair.Settings(rows=rows)).collect()}
    assert got == wanted(data)
    if seed == 1:
        assert {r["conv_id"]: tuple(r) for r in repair.repair(df).collect()} == wanted(data, damage=False)


def test_repair_of_a_long_conversation(spark):
    """One conversation of most rows, over many partitions, with one text very often."""
    rng = random.Random(8)
    data = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"Text {t}.", f"text {t}"])) for t in range(3000)] + made(5, 10)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = {r["conv_id"]: tuple(r) for r in repair.repair(repair.damage(df), repair.Settings(rows=100)).collect()}
    assert got == wanted(data)


def test_all_edit_strings():
    """Short conversations against every edit string there is."""
    rng = random.Random(3)
    for _ in range(150):
        rows = [(0, i, rng.choice(["system", "user", "assistant", "tool"]), "") for i in range(rng.randint(0, 3))]
        found = [rng.choice(["", "", "t", "b"]) for _ in rows]
        best = None
        for size in range(len(rows) + 4):
            for edits in itertools.product("DIKR", repeat=size):
                at, s, cost = 0, 0, 0
                for e in edits:
                    if e == "I":
                        s, cost = (2, 2, 3, 2)[s], cost + 3
                        continue
                    if at == len(rows) or (e != "D" and found[at] == "b"):
                        break
                    cost += {"D": 4, "K": 0, "R": 3}[e] + (3 if e != "D" and found[at] == "t" else 0)
                    s = s if e == "D" else (2, 2, 3, 2)[s] if e == "R" else keeps(s, rows[at][2][:1])
                    at += 1
                    if s is None:
                        break
                else:
                    if at == len(rows) and s in (0, 3):
                        best = min(best or (BIG, ""), (cost, "".join(edits)))
        marks = "".join((r[2][0] if r[2][0] in "sua" else "x") + {"b": "D", "t": "T", "": "-"}[f] for r, f in zip(rows, found))
        assert repair.audit_of(marks) == best == cheapest(rows, found)


@pytest.mark.parametrize("mod", [repair.MOD, 5, 1])
def test_comparison_survives_collisions(monkeypatch, mod):
    """Hashes that nearly always, or always, collide change no result."""
    monkeypatch.setattr(repair, "MOD", mod)
    rng = random.Random(mod)
    nodes = [(repair.Path(), "")]
    for _ in range(300):
        parent, said = rng.choice(nodes[-40:])
        text = "".join(rng.choice("DK") for _ in range(rng.choice([1, 1, 1, 7])))
        nodes.append((repair.Path(parent, text), said + text))
    for _ in range(1500):
        (a, x), (b, y) = rng.choice(nodes), rng.choice(nodes)
        assert repair.before(a, b) == (x < y) and str(a) == x
    repair._short.cache_clear()
    for rows in ("uTaTu-a-xTuDaDu-", "a-a-s-xDuTuT" * 3):
        own = [(0, i, {"u": "user", "a": "assistant", "s": "system", "x": "tool"}[rows[2 * i]], "") for i in range(len(rows) // 2)]
        assert repair.audit_of(rows) == cheapest(own, [{"D": "b", "T": "t", "-": ""}[rows[2 * i + 1]] for i in range(len(rows) // 2)])
    repair._short.cache_clear()


def test_sql(spark, tmp_path):
    data = [r for r in made(11) if r[0] != -5]
    spark.createDataFrame(data, SCHEMA).repartition(2).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    out = queries.QUERIES["op13_repair"](spark, str(tmp_path))
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted(con.execute(f"select {', '.join(out.columns)} from ({repair.ORACLE_SQL})").fetchall(), key=repr)
    assert got == sorted(wanted(data).values(), key=repr)


def test_registered_query(spark, sf_dir):
    data = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r) for r in queries.QUERIES["op13_repair"](spark, sf_dir).collect()} == wanted(data)


def test_empty_and_dropped(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    row = repair.repair(repair.damage(spark.createDataFrame([(1, gone, "user", "Hi.")], SCHEMA))).collect()
    assert [tuple(r) for r in row] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
