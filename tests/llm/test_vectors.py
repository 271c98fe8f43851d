from __future__ import annotations

import numpy as np

from quadrante.llm.multi_index import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def vectors(seed=1, groups=40):
    rng = np.random.default_rng(seed)
    rows = []
    for group in range(groups):
        base = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 9))):
            noisy = base + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.35])
            rows.append((len(rows), [float(np.float32(x)) for x in noisy * rng.choice([0.1, 1, 9])], int(group % 3), "x"))
    rows += [(len(rows) + k, rows[3][1], rows[3][2], "x") for k in range(60)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 8, [1.0] * 8, [None] + [1.0] * 15]
    rows += [(1000 + k, v, 1, "x") for k, v in enumerate(odd)] + [(2000, rows[3][1], None, "x"), (2001, rows[3][1], 77, "x"), (None, rows[3][1], rows[3][2], "x")]
    return rows


def brute(rows):
    def unit(v):
        x = np.array([np.nan if c is None else c for c in v or []], np.float64)
        return None if not len(x) or not np.isfinite(x).all() or not x.any() else x / np.linalg.norm(x)

    units = [unit(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if a[2] is None or a[2] != b[2] or units[i] is None or units[j] is None or len(units[i]) != len(units[j]):
                continue
            if units[i] @ units[j] >= 0.93:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return {i: (rows[i][0], links[i], least.get(root(i))) for i in range(len(rows))}


def test_links_components_and_recall(spark):
    rows = vectors()
    want = sorted(brute(rows).values(), key=str)
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert sum(r["n_links"] for r in got) >= 0.9 * sum(w[1] for w in want)
    mine = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str)
    truth = {w[0]: w for w in want}
    assert all(n <= truth[v][1] for v, n, _ in mine if v is not None)
    assert sum(a == b for a, b in zip(mine, want)) >= 0.9 * len(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_all_cells_find_all_links(spark):
    """With fewer than a hundred sampled links the certain limit is used, which loses none."""
    rows = vectors(2, groups=60)
    got = near_vectors(spark.createDataFrame(rows, SCHEMA), sample=20).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == sorted(brute(rows).values(), key=str)


def test_no_vectors(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    (only,) = near_vectors(spark.createDataFrame([(3, None, 1, "x")], SCHEMA)).collect()
    assert only.asDict() == {"vec_id": 3, "n_links": 0, "component_id": 3, "kept": True}
