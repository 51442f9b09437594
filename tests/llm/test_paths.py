"""Compaction of plain paths by joins, against walking them one node at a time."""

import random

from grainfield.llm import substring

NODES = "node long, source long, branches boolean, before long, gap int"
DOCS = "doc_id long, text string"


def test_plain_paths(spark):
    rng = random.Random(2)
    rows, node = [], 0
    for size in (1, 2, 3, 64, 65, 200):
        for i in range(size):
            node += 1
            # a path begins at a text's start, behind a node that branches, or behind one that is not repeated
            rows.append((node, 0, False, node - 1 if i else rng.choice([None, -1, 10**6]), rng.randint(1, 60) if i else None))
    rows.append((-1, 0, True, None, None))
    by = {r[0]: r for r in rows if not r[2]}

    def walk(n):
        along = 0
        while by[n][3] in by:
            along, n = along + by[n][4], by[n][3]
        return n, along

    got = {r["node"]: (r["head"], r["along"]) for r in substring.plain_paths(spark.createDataFrame(rows, NODES).repartition(3)).collect()}
    assert got == {n: walk(n) for n in by}
    assert substring.plain_paths(spark.createDataFrame([], NODES)).count() == 0


def test_a_walk_is_one_row(spark):
    """Copies of a long text walk one path; one with a word changed walks two."""
    rng = random.Random(1)
    words = [str(rng.randrange(10**6)) for _ in range(3000)]
    other = [*words[:1500], "x", *words[1501:]]
    docs = spark.createDataFrame([(0, " ".join(words)), (1, " ".join(words)), (2, " ".join(other))], DOCS)
    anchors = substring.anchor_table(docs, 50).persist()
    nodes = substring.repeated_nodes(anchors).persist()
    marks = {r["doc_id"]: [m for m in r["marks"] if not m & 1] for r in substring.walks(anchors, nodes, substring.plain_paths(nodes)).collect()}
    assert nodes.where("not branches").count() > 100 and all(1 <= len(m) <= 3 for m in marks.values()) and len(marks) == 3
    assert {m >> 1 & 1 for m in marks[0]} == {0} and {m >> 1 & 1 for d in (1, 2) for m in marks[d]} == {1}
    got = {r["doc_id"]: r["n_removed"] for r in substring.repeats(docs).collect()}
    assert got == {0: 0, 1: 3000, 2: 2999}
