from __future__ import annotations

import hashlib
import math
import random
import zlib

import pytest

from quadrante.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn int, role string, text string, depth long, leaves long, kids string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h]) + tuple(own[h:])
    members: dict[tuple, list] = {}
    for c, s in rebuilt.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children: dict[tuple, list] = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    totals, out = {}, []
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        own = (len(members[p]) - 1) * len(p[-1][1].encode() if p else b"")
        totals[p] = (sum(totals[q][0] for q in below) or 1, own + sum(totals[q][1] for q in below))
        ends = ",".join(map(str, sorted(c for c in members[p] if len(rebuilt[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(members[p]), len(p), parent, len(members[p]), len(below), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def check(spark, rows):
    df = spark.createDataFrame([(*r, -1, -1, "x") for r in rows], SCHEMA)
    got = trie.conversation_trie(df)
    assert got.columns == COLUMNS
    assert {t for c, t in got.dtypes[:-1]} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2]) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = [(None, 0, "user", "lost"), (3, None, None, None), (3, None, "user", "b"), (3, 1, "user", "ü"), (3, 1, "user", "ü"), (3, 1, "a", "z")]
    rows += [(-7, 0, "user", "negative"), (-5, 0, "user", "base"), (40, 0, "user", "x" * 50_000), (41, 0, "user", "")]
    for c in range(100, 160):
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", None, "bot"]), rng.choice(["a", "b", None, "cc"])) for t in range(rng.randint(1, 12))]
    rng.shuffle(rows)
    check(spark, rows)


def test_empty_and_one(spark):
    check(spark, [])
    check(spark, [(None, 1, "a", "b")])
    check(spark, [(8, 1, "a", "b")])


@pytest.mark.parametrize("hot", ["chain", "copies"])
def test_hot(spark, hot, monkeypatch):
    """One conversation with most rows lies in many pieces; many conversations end in one node, in many rows of text."""
    monkeypatch.setattr(trie, "CHUNK", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        if hot == "chain":
            rows = [(10, t, "user", f"turn {t % 7}") for t in range(700)] + [(c, t, "user", f"turn {t % 7}") for c in (11, 12, 20) for t in range(30)]
        else:
            rows = [(5 * c, t, "user", f"same {t}") for c in range(900) for t in range(2)]
        check(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("shape", ["chain", "comb", "random"])
def test_contraction_of_any_tree(spark, shape):
    """Totals of trees that are no tries, and as many rounds as the logarithm of the depth calls for."""
    rng, size = random.Random(shape), 300
    parent = {n: n - 1 if shape == "chain" else max(n - 1 - n % 2, 0) if shape == "comb" else rng.randrange(max(0, n - 4), n) for n in range(1, size)}
    depth = {0: 0}
    for n in range(1, size):
        depth[n] = depth[parent[n]] + 1
    kids = [sum(p == n for p in parent.values()) for n in range(size)]
    weights = [rng.randrange(100) for _ in range(size)]
    rows = [(n, depth[n], parent.get(n), depth[parent[n]] if n else None, kids[n], int(not kids[n]), weights[n]) for n in range(size)]
    tree = spark.createDataFrame(rows, "conv_id long, depth long, p_conv long, p_depth long, kids long, leaves long, saved long")
    leaves, saved = [int(not k) for k in kids], list(weights)
    for n in range(size - 1, 0, -1):
        leaves[parent[n]] += leaves[n]
        saved[parent[n]] += saved[n]
    got = trie.subtree_totals(tree)
    assert sorted(tuple(r) for r in got.collect()) == [(n, depth[n], leaves[n], saved[n]) for n in range(size)]


def test_matches_sql(spark, duck_sources):
    import __spark_entry__ as entry_point
    from conftest import TESTDATA

    name = "op11_conversation_trie"
    expected = duck_sources.execute(entry_point.oracle_sql()[name])
    columns = [c[0] for c in expected.description]
    got = entry_point.queries()[name](spark, str(TESTDATA / "sf0.001")).select(*columns)
    key = lambda r: r[:2]
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(expected.fetchall(), key=key)
