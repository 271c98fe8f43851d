"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length one and cut in halves; each half has its own codebook, and the product of the two
codebooks is a grid of cells. A vector lies in the cell of its nearest codewords. For a cell ``(i, j)`` and a vector,
the distances of the vector's halves to the bisecting planes between its own codewords and ``i``, ``j``
bound from below how far anything in the cell is. The multi-sequence traversal visits cells by the
sum of the two squared bounds, nearest first, until the sum passes a limit. For links of cosine ``c`` no cell
beyond ``2 - 2c`` can hold a partner, so that limit would find all; the limit used is the least one that finds
``recall`` of the links among a sample of vectors.

Equal vectors of one label are one vector with a count, so large groups of copies cost nothing. A cell's
vectors and the queries that visit it are dealt to blocks of bounded size; a block compares all its
queries with all its vectors in double precision by matrix products and returns, per vector, the number of links
and a spanning forest of them, never the pairs. A pair is counted from both sides: where only one side visits the
other's cell, that side counts for both. So results are symmetric.

The codebooks and the limit are fitted on at most ``sample`` vectors (those with the smallest hashes); all
vectors are indexed. Measured recall against brute force: see the README.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without
label, have no links and are their own component; only vectors of equal label and length are compared; equal
rows are vectors of their own and link; rows with a null ``vec_id`` count as partners, their ``kept`` is
null and their component is the smallest id reachable, if any; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrante.llm.common import connected_components, stored

MEMBER_BLOCK, QUERY_BLOCK = 2048, 4096


class Index(NamedTuple):
    """Codebooks of both halves and the traversal's limit on the sum of squared bounds."""

    first: np.ndarray
    second: np.ndarray
    limit: float

    def bounds(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codewords and squared lower bounds of each half."""
        half = self.first.shape[1]
        own1, bound1 = _bounds(unit[:, :half], self.first)
        own2, bound2 = _bounds(unit[:, half:], self.second)
        return own1, own2, bound1, bound2


def _squares(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :], 0)


def _bounds(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    squares = _squares(x, centres)
    own = squares.argmin(1)
    apart = np.sqrt(_squares(centres, centres))[own]
    away = squares - squares[np.arange(len(x)), own][:, None]
    return own, (away / np.maximum(2 * apart, 1e-12)) ** 2 * (apart > 0)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from spread-out starts; deterministic."""
    generator = np.random.default_rng(5)
    centres = x[generator.choice(len(x), 1)]
    least = _squares(x, centres)[:, 0]
    while len(centres) < k and least.max() > 1e-9:
        centres = np.vstack([centres, x[generator.choice(len(x), p=least / least.sum())]])
        least = np.minimum(least, _squares(x, centres[-1:])[:, 0])
    for _ in range(rounds):
        own = _squares(x, centres).argmin(1)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def fit(sample: np.ndarray, groups: np.ndarray, codewords: int, cosine: float, recall: float) -> Index:
    """Codebooks from unit vectors, and the limit from the links among them (of equal ``groups``)."""
    half = sample.shape[1] // 2
    index = Index(k_means(sample[:, :half], codewords), k_means(sample[:, half:], codewords), 0.0)
    own1, own2, bound1, bound2 = index.bounds(sample)
    needed = []
    for group in np.unique(groups):
        rows = np.flatnonzero(groups == group)
        for a in range(0, len(rows), 512):
            i, j = np.nonzero(sample[rows[a : a + 512]] @ sample[rows].T >= cosine)
            x, y = rows[a + i], rows[j]
            x, y = x[x != y], y[x != y]
            needed.append(np.minimum(bound1[x, own1[y]] + bound2[x, own2[y]], bound1[y, own1[x]] + bound2[y, own2[x]]))
    needed = np.concatenate(needed) if needed else np.zeros(0)
    certain = 2 - 2 * cosine
    # A quarter of the certain limit at least: links weaker than the sampled ones may be asked for.
    limit = certain if len(needed) < 100 else min(certain, max(certain / 4, float(np.quantile(needed, recall))))
    return index._replace(limit=limit)


def _unit(batch: pa.RecordBatch, width: int) -> np.ndarray:
    units = np.zeros((batch.num_rows, width))
    for k, raw in enumerate(batch["unit"]):
        own = np.frombuffer(raw.as_buffer(), "<f8")
        units[k, : len(own)] = own
    return units


def usable(embeddings: DataFrame) -> DataFrame:
    """``(seq, vec_id, label, size, unit)``, stored: unit vectors as doubles (``null``: links with nothing)."""

    def scale(batches):
        for batch in batches:
            units, sizes = [], []
            for vector, label in zip(batch["vector"].to_pylist(), batch["label"].to_pylist()):
                unit = None
                if label is not None and vector and None not in vector:
                    x = np.array(vector, np.float64)
                    with np.errstate(over="ignore", invalid="ignore"):
                        if np.isfinite(x).all() and np.abs(x).max() > 0:
                            x = x / np.abs(x).max()
                            unit = (x / np.linalg.norm(x)).astype("<f8").tobytes()
                units.append(unit)
                sizes.append(len(vector) if unit else 0)
            yield pa.RecordBatch.from_arrays(
                [batch["seq"], batch["vec_id"], batch["label"], pa.array(sizes, pa.int32()), pa.array(units, pa.binary())],
                ["seq", "vec_id", "label", "size", "unit"],
            )

    rows = embeddings.select(
        F.monotonically_increasing_id().alias("seq"),
        embeddings["vec_id"].cast("long").alias("vec_id"),
        embeddings["label"].cast("long").alias("label"),
        embeddings["embedding"].cast("array<double>").alias("vector"),
    )
    return stored(rows.mapInArrow(scale, "seq long, vec_id long, label long, size int, unit binary"))


def _codewords(vectors: int, labels: int) -> int:
    """Per half, so that a cell of one label holds some two hundred vectors on average."""
    return int(np.clip(round((vectors / max(1, labels) / 200) ** 0.5), 2, 256))


def _visits(index):
    """A row per vector as member of its cell, and one per cell that it visits."""

    def run(batches):
        fitted = index.value
        columns = len(fitted.second)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                own1, own2, bound1, bound2 = fitted.bounds(_unit(part, 2 * fitted.first.shape[1]))
                rows, cells, roles = [np.arange(len(own1))], [own1 * columns + own2], [np.zeros(len(own1), np.int32)]
                # All cells within the limit, nearest first; the traversal's order does not change the set.
                total = bound1[:, :, None] + bound2[:, None, :]
                row, i, j = np.nonzero(total <= fitted.limit)
                order = np.lexsort((total[row, i, j], row))
                rows.append(row[order])
                cells.append((i * columns + j)[order])
                roles.append(np.ones(len(row), np.int32))
                taken = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part[n].take(taken) for n in ("seq", "label", "size", "copies")),
                        pa.array(np.concatenate(cells).astype(np.int64)),
                        pa.array(np.concatenate(roles)),
                    ],
                    ["seq", "label", "size", "copies", "cell", "role"],
                )

    return run


def _compared(index, cosine: float):
    """Links of a block: rows ``(seq, links, to)``; ``to`` is an edge of a spanning forest, or null."""

    def run(key, table):
        fitted = index.value
        columns = len(fitted.second)
        role = table["role"].to_numpy()
        order = np.lexsort((table["seq"].to_numpy(), role))
        table = table.take(pa.array(order))
        role = role[order]
        seq, copies = table["seq"].to_numpy(), table["copies"].to_numpy()
        cut = int((role == 0).sum())
        units = np.stack([np.frombuffer(v.as_buffer(), "<f8") for v in table["unit"]])
        width = 2 * fitted.first.shape[1]
        padded = np.pad(units, ((0, 0), (0, width - units.shape[1])))
        links = np.zeros(len(seq), np.int64)
        tree: dict[int, int] = {}
        edges: list[tuple[int, int]] = []
        if cut and cut < len(seq):
            # Which cells the members visit: where a member does not visit the query's, the query counts for both.
            _, _, visit1, visit2 = fitted.bounds(padded[:cut])
            for a in range(cut, len(seq), 512):
                b = min(a + 512, len(seq))
                near = units[a:b] @ units[:cut].T >= cosine
                near &= seq[a:b, None] != seq[None, :cut]
                if not near.any():
                    continue
                links[a:b] += near @ copies[:cut]
                own1, own2, _, _ = fitted.bounds(padded[a:b])
                back = visit1[:, own1] + visit2[:, own2] <= fitted.limit
                links[:cut] += (near.T & ~back) @ copies[a:b]
                _span(near, seq[a:b], seq[:cut], tree, edges)
        counted = np.flatnonzero(links)
        out_seq = np.concatenate([seq[counted], np.array([x for x, _ in edges], np.int64)])
        out_links = np.concatenate([links[counted], np.zeros(len(edges), np.int64)])
        to = [None] * len(counted) + [y for _, y in edges]
        return pa.table({"seq": pa.array(out_seq), "links": pa.array(out_links), "to": pa.array(to, pa.int64())})

    return run


def _root(tree: dict[int, int], x: int) -> int:
    while (up := tree.setdefault(x, x)) != x:
        tree[x] = x = tree[up]
    return x


def _span(near: np.ndarray, queries: np.ndarray, members: np.ndarray, tree: dict[int, int], edges: list) -> None:
    for row in np.flatnonzero(near.any(1)):
        x = int(queries[row])
        for y in members[near[row]].tolist():
            a, b = _root(tree, x), _root(tree, y)
            if a != b:
                tree[max(a, b)] = min(a, b)
                edges.append((x, y))


def near_vectors(embeddings: DataFrame, cosine: float = 0.93, recall: float = 0.995, sample: int = 8000) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``embeddings``."""
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    keyed = rows.where("unit is not null").withColumn("key", F.expr("sha2(unit, 256)"))
    # Equal vectors of a label: one vector and its copies.
    same = keyed.groupBy("label", "size", "key").agg(F.min(F.struct("seq", "unit")).alias("first"), F.count("*").alias("copies"))
    same = stored(same.select(F.col("first.seq").alias("seq"), "label", "size", "key", F.col("first.unit").alias("unit"), "copies"))
    counts = same.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels"), F.max("size").alias("size")).first()
    if not counts["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    # The bound is found on the hashes alone, so no vectors are sorted in one task.
    hashed = F.xxhash64("seq")
    last = same.select(hashed.alias("h")).orderBy("h").limit(sample).agg(F.max("h").alias("h")).first()["h"]
    taken = same.where(hashed <= F.lit(last)).select("seq", "label", "size", "unit").collect()
    taken.sort(key=lambda row: row["seq"])
    width = counts["size"] + counts["size"] % 2
    units = np.zeros((len(taken), width))
    for k, row in enumerate(taken):
        units[k, : row["size"]] = np.frombuffer(bytes(row["unit"]), "<f8")
    groups = np.unique([(r["label"], r["size"]) for r in taken], axis=0, return_inverse=True)[1].reshape(-1)
    index = spark.sparkContext.broadcast(fit(units, groups, _codewords(counts["n"], counts["labels"]), cosine, recall))

    visits = stored(same.select("seq", "label", "size", "copies", "unit").mapInArrow(_visits(index), "seq long, label long, size int, copies long, cell long, role int"))
    cell = ["label", "size", "cell"]
    blocks = visits.groupBy(*cell).agg(F.sum(1 - F.col("role")).alias("members"), F.sum("role").alias("queries")).where("members > 0")
    blocks = blocks.select(
        *cell, F.ceil(F.col("members") / MEMBER_BLOCK).cast("int").alias("m"), F.ceil(F.col("queries") / QUERY_BLOCK).cast("int").alias("q")
    )
    dealt = visits.join(blocks, cell)
    salt = F.xxhash64("seq")
    side = lambda own, n: F.when(own, F.array(F.pmod(salt, F.col(n)).cast("int"))).otherwise(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = dealt.withColumn("mb", F.explode(side(F.col("role") == 0, "m"))).withColumn("qb", F.explode(side(F.col("role") == 1, "q")))
    dealt = dealt.select("seq", *cell, "mb", "qb", "role", "copies").join(same.select("seq", "unit"), "seq")
    found = stored(dealt.groupBy(*cell, "mb", "qb").applyInArrow(_compared(index, cosine), "seq long, links long, to long"))

    roots = connected_components(found.where("to is not null").select(F.col("seq").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("seq").agg(F.sum("links").alias("links"))
    vectors = same.join(links, "seq", "left").join(roots.withColumnRenamed("node", "seq"), "seq", "left")
    vectors = vectors.select("label", "size", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "seq").alias("component"))
    joined = keyed.select("seq", "vec_id", "label", "size", "key").join(vectors, ["label", "size", "key"]).select("seq", "vec_id", "n_links", "component")
    joined = stored(joined)
    least = joined.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    joined = joined.join(least, "component").select("vec_id", "n_links", "component_id")
    alone = rows.where("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
