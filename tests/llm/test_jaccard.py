from __future__ import annotations

import random
import re

import pytest

from quadrante.llm import jaccard
from quadrante.llm.common import connected_components
from tests.llm.conftest import odd_rows, prose

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(words[k:] for k in range(5)))) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common and 100 * common >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted(((d, len(sets[i]), least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(docs, **how):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs, **how).collect()), key=str)


def noisy(rng, words, share):
    return " ".join(rng.choice("xyzw") + str(rng.randrange(99)) if rng.random() < share else w for w in words)


def many(seed):
    """Groups around the threshold, a chain, shared passages and short texts."""
    rng = random.Random(seed)
    rows = []
    for group in range(12):
        base = prose(seed * 100 + group, rng.choice([12, 60, 150])).split()
        rows += [(len(rows) + k, noisy(rng, base, rng.choice([0, 0.01, 0.03, 0.05]))) for k in range(rng.choice([1, 3, 9]))]
    passage = prose(seed + 5000, 30)
    rows += [(1000 + k, f"{prose(seed * 7 + k, 40)} {passage} {prose(seed * 9 + k, 30)}") for k in range(30)]
    chain = prose(seed + 6000, 100).split()
    rows += [(2000 - k, " ".join(chain[k * 2 : k * 2 + 60])) for k in range(15)]
    rng.shuffle(rows)
    return rows


def test_odd_rows(documents):
    assert got(documents(odd_rows())) == brute(odd_rows())


@pytest.mark.parametrize(("seed", "how"), [(1, {}), (2, {"group_sets": 3})])
def test_random_groups(documents, seed, how):
    assert got(documents(many(seed)), **how) == brute(many(seed))


def test_longest_lists_are_counted_only_where_the_others_leave_it_open(documents, monkeypatch):
    """Sets that meet their own lead, or reach the bound without them, made one row for each of their longest lists."""
    count, seen = jaccard._counted_lists, []

    def counted(cells, open_, matrix):
        seen.append((cells.where("long").count(), open_.join(cells.where("long"), "number").count()))
        return count(cells, open_, matrix)

    monkeypatch.setattr(jaccard, "_counted_lists", counted)
    rng = random.Random(9)
    rows = [(100 * g + k, noisy(rng, prose(70 + g, 200).split(), 0.01)) for g in range(4) for k in range(25)]
    assert got(documents(rows)) == brute(rows)
    longest, counts = seen[0]
    assert longest > 500 and counts < longest / 10


def test_hot_shingles_take_the_other_way(documents, monkeypatch):
    levels = jaccard._sketch_levels
    monkeypatch.setattr(jaccard, "_sketch_levels", lambda rows: (levels(rows)[0], 1))
    assert got(documents(many(3))) == brute(many(3))


def test_no_documents(documents):
    assert got(documents([])) == [] and got(documents([(1, None), (2, "")])) == brute([(1, None), (2, "")])


def test_components_of_random_graphs(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(110)] + [(k, k + 1) for k in range(200, 260)] + [(500, 500 + k) for k in range(1, 40)]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    frame = spark.createDataFrame([*edges, (None, 1)], "a long, b long")
    assert sorted(map(tuple, connected_components(frame).collect())) == sorted((x, root(x)) for x in list(parent))
    assert connected_components(frame.limit(0)).count() == 0
