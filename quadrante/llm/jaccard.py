"""Exact n-gram Jaccard join with a token-group matrix.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets of word shingles. The join is
exact (up to the equality of 64-bit hashes) and finds no pair twice:

1. *Sets.* Documents of equal shingle sets are one set, numbered by a hash of the set.
2. *Order.* A sketch of fixed size counts all shingles of all documents; its level, then the hash, orders them
   from rare to frequent. Sets that link must share at least ``l`` of the first ``n - ceil(t n) + l``
   shingles of this order (``l`` a tenth of the set), so only these prefixes are compared. Passages that
   many documents share are frequent and come late, so they bring few sets together.
3. *Lists.* Prefix shingles are dealt to buckets in packed form; those of one set only go. Shingles that
   the sketch calls hot skip the buckets, as their lists have no bound.
4. *Groups.* Each set joins the group of the longest list that it is in, as similar sets meet there; groups over
   ``group_sets`` sets are dealt to several by hash.
5. *Matrix.* Shingle -> group rows give, for each set and group, how many prefix shingles the set has in the group's
   token union (of groups with the same longest list, in their common union). As ``l`` of them are needed, one is not among the
   set's ``l - 1`` longest lists: candidates come from the other lists alone, and the longest ones are only counted for
   candidates that the others leave open. Pairs below the bound of step 2 are dropped; only the groups left are opened.
6. *Verification.* An opened group meets its query sets in one task, block by block: the union of its members'
   sets bounds each query again, then products of 0/1 matrices over the shared shingles give all
   intersections. Tasks return a spanning forest of the links they find, never the pairs.

Nothing but the sketch's levels (fixed size) reaches the driver. Unlinked sets leave before their shingles are
moved: the sets of step 6 are read from the texts again, only for sets that passed step 5.

Words are maximal runs without ASCII white space, A-Z as a-z. Defined results: a null or wordless text has the
empty set, links with nothing and is its own component; fewer words than a shingle count as one shingle; equal
rows link; a null ``doc_id`` is no candidate for the smallest id, and its component is null when no row that it
reaches has an id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrante.llm.common import connected_components, discard, slices, stored

SKETCH_BITS = 22
_CHUNKS = 64
_BUCKET_TOKENS = 1_000_000
_QUERY_BLOCK = 1024
_HOT_LENGTH = 512  # at least so many occurrences make a shingle hot, whose list is not counted
_ODD = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 | 1 for k in range(256)], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    size = min(words, len(hashes))
    total = np.full(len(hashes) - size + 1, size, np.uint64)
    for k in range(size):
        total += _mixed(hashes[k : k + len(total)] * _ODD[k % 256] + np.uint64(k))
    return np.unique(_mixed(total))


def set_number(tokens: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes()))))


def required(n: int, percent: int) -> int:
    """Least intersection of a set of ``n`` with a set it links to."""
    return -(-percent * n // 100)


def extra(n: int) -> int:
    """Prefix shingles that linked sets must share at least, for a set of ``n``."""
    return max(1, n // 10)


def prefix(tokens: np.ndarray, levels: np.ndarray, percent: int) -> np.ndarray:
    n = len(tokens)
    size = min(n, n - required(n, percent) + extra(n))
    level = levels[tokens >> np.uint64(64 - SKETCH_BITS)]
    if level.max(initial=0) == level.min(initial=255):
        return tokens[:size]
    return tokens[np.argsort(level, kind="stable")[:size]]


def _sets_and_sketch(words: int):
    """Rows of kind 0: ``(id, set, n)`` of each document; of kind 1: a chunk of the task's sketch."""

    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in slices(batches):
            numbers, sizes = [], []
            for text in batch["text"].to_pylist():
                tokens = shingle_set(text, words)
                sizes.append(len(tokens))
                numbers.append(set_number(tokens) if len(tokens) else None)
                np.add.at(sketch, (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            yield out(0, batch["doc_id"], batch["hash"], pa.array(numbers, pa.int64()), sizes, [None] * len(sizes))
        chunks = [zlib.compress(part.tobytes(), 1) for part in np.split(sketch, _CHUNKS)]
        yield out(1, pa.nulls(_CHUNKS, pa.int64()), pa.nulls(_CHUNKS, pa.int64()), pa.array(range(_CHUNKS), pa.int64()), [0] * _CHUNKS, chunks)

    def out(kind, ids, hashes, numbers, sizes, chunks):
        arrays = [pa.array([kind] * len(sizes), pa.int32()), ids, hashes, numbers, pa.array(sizes, pa.int64()), pa.array(chunks, pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, ["kind", "doc_id", "hash", "number", "n", "chunk"])

    return run


def _sketch_levels(rows: DataFrame) -> tuple[np.ndarray, int]:
    """Level of each counter of the whole table's sketch, and the level from which shingles are hot."""

    def add(table):
        total = np.zeros((1 << SKETCH_BITS) // _CHUNKS, np.int64)
        for chunk in table["chunk"].to_pylist():
            total += np.frombuffer(zlib.decompress(chunk), np.uint32)
        data = zlib.compress(total.tobytes(), 1)
        return pa.table({"number": table["number"][:1], "sum": pa.array([total.sum()], pa.int64()), "data": pa.array([data], pa.binary())})

    summed = rows.where("kind = 1").select("number", "chunk").groupBy("number").applyInArrow(add, "number long, sum long, data binary")
    parts = {r["number"]: r["data"] for r in summed.collect()}  # 2**SKETCH_BITS counters, whatever the input
    if not parts:
        return np.zeros(1 << SKETCH_BITS, np.uint8), 1
    counts = np.concatenate([np.frombuffer(zlib.decompress(parts[k]), np.int64) for k in range(_CHUNKS)])
    mean = max(1.0, counts.mean())
    levels = np.clip(4 * np.log2(np.maximum(counts, 1) / mean), 0, 255).astype(np.uint8)
    return levels, int(4 * np.log2(max(8.0, _HOT_LENGTH / mean)))


def _token_rows(levels, hot: int, words: int, percent: int, buckets: int):
    """Packed prefix shingles by bucket; hot shingles by negative buckets, dealt by set."""

    def run(batches):
        level_of = levels.value
        seen: set[int] = set()
        for batch in batches:
            tokens, owners, sizes = [], [], []
            for text in (t for part in slices([batch]) for t in part["text"].to_pylist()):
                own = shingle_set(text, words)
                if len(own) == 0 or (number := set_number(own)) in seen:
                    continue
                if len(seen) < 200_000:
                    seen.add(number)
                first = prefix(own, level_of, percent)
                tokens.append(first)
                owners.append(np.full(len(first), number, np.int64))
                sizes.append(np.full(len(first), len(own), np.int32))
            if not tokens:
                continue
            tokens, owners, sizes = np.concatenate(tokens), np.concatenate(owners), np.concatenate(sizes)
            is_hot = level_of[tokens >> np.uint64(64 - SKETCH_BITS)] >= hot
            dealt = np.where(is_hot, owners.view(np.uint64), tokens)
            bucket = (_mixed(dealt) % np.uint64(buckets)).astype(np.int64)
            bucket = np.where(is_hot, -1 - bucket, bucket)
            order = np.lexsort((owners, bucket))
            bucket, tokens, owners, sizes = (x[order] for x in (bucket, tokens, owners, sizes))
            ends = np.flatnonzero(np.diff(bucket, append=buckets)) + 1
            # Each set once for its shingles in a bucket.
            change = np.flatnonzero(np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (owners[1:] != owners[:-1]))))
            runs = np.diff(np.append(change, len(bucket))).astype(np.int32)
            owners, sizes = owners[change], sizes[change]
            cuts = [0, *ends]
            marks = np.searchsorted(change, cuts)
            parts = [(tokens, cuts), (owners, marks), (sizes, marks), (runs, marks)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[ends - 1], pa.int64()), *(pa.array([x[i:j].tobytes() for i, j in zip(at, at[1:])], pa.binary()) for x, at in parts)],
                ["bucket", "tokens", "owners", "sizes", "runs"],
            )

    return run


def _repeated(key, table):
    """The bucket's shingles that two or more sets have, with the lengths of their lists; of a negative bucket, all."""
    tokens, owners, sizes, runs = (
        np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()])
        for name, kind in (("tokens", np.uint64), ("owners", np.int64), ("sizes", np.int32), ("runs", np.int32))
    )
    owners, sizes = np.repeat(owners, runs), np.repeat(sizes, runs)
    order = np.lexsort((owners, tokens))
    tokens, owners, sizes = tokens[order], owners[order], sizes[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
    tokens, owners, sizes = tokens[new], owners[new], sizes[new]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    lengths = np.diff(np.append(starts, len(tokens)))
    lengths = np.repeat(lengths, lengths).astype(np.int32)
    if key[0].as_py() < 0:
        lengths = np.full(len(tokens), _HOT_LENGTH, np.int32)
    keep = lengths > 1
    columns = {"token": tokens.view(np.int64), "number": owners, "n": sizes, "length": lengths}
    return pa.table({name: pa.array(values[keep]) for name, values in columns.items()})


def _opened(percent: int):
    """Links between a group's members (role 0) and query sets (role 1), as a spanning forest."""

    def run(key, table):
        role = np.array(table["role"].to_pylist())
        number = np.array(table["number"].to_pylist(), np.int64)
        sets = [np.frombuffer(x, np.uint64) for x in table["tokens"].to_pylist()]
        members = [k for k in np.flatnonzero(role == 0)]
        _, first = np.unique(number[members], return_index=True) if members else (0, [])
        members = [members[k] for k in sorted(first)]
        links: list[tuple[int, int]] = []
        if members:
            union = np.unique(np.concatenate([sets[k] for k in members]))
            sizes = np.array([len(sets[k]) for k in members])
            queries = []
            for k in {int(number[k]): k for k in np.flatnonzero(role == 1)}.values():
                at = np.searchsorted(union, sets[k])
                at[at == len(union)] = 0
                inside = at[union[at] == sets[k]]
                if len(inside) >= required(max(len(sets[k]), int(sizes.min())), percent):
                    queries.append((k, inside))
            forest = _Forest()
            for a in range(0, len(queries), 64):
                _link(queries[a : a + 64], members, sets, sizes, union, number, percent, forest)
            links = forest.links
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return run


class _Forest:
    """Keeps a link only if it joins two trees."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[up]
        return x

    def add(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((x, y))


def _link(queries, members, sets, sizes, union, number, percent: int, forest: _Forest) -> None:
    """Adds to ``forest`` the links of some queries with all members.

    The columns are the shingles that these queries have in the union, in slices, so the matrices stay small.
    """
    columns = np.unique(np.concatenate([inside for _, inside in queries]))
    tokens = union[columns]
    common = np.zeros((len(queries), len(members)), np.float32)
    rows = [np.searchsorted(columns, inside) for _, inside in queries]
    found = []
    for k in members:
        at = np.searchsorted(tokens, sets[k])
        at[at == len(tokens)] = 0
        found.append(at[tokens[at] == sets[k]])
    step = 8192
    for lo in range(0, len(tokens), step):
        width = min(step, len(tokens) - lo)
        left, right = (np.zeros((len(x), width), np.float32) for x in (queries, members))
        for matrix, places in ((left, rows), (right, found)):
            for i, place in enumerate(places):
                a, b = np.searchsorted(place, (lo, lo + width))
                matrix[i, place[a:b] - lo] = 1
        common += left @ right.T
    own = np.array([len(sets[k]) for k, _ in queries])
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (own[:, None] + sizes[None, :] - common)
    for i, j in zip(*np.nonzero(linked)):
        forest.add(int(number[queries[i][0]]), int(number[members[j]]))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80, group_sets: int = 256) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs``; component: smallest ``doc_id`` reachable by links."""
    own, named = _named_sets(docs, words, percent, group_sets)
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = named.join(smallest, "component").select("number", "component_id")
    out = own.join(final, "number", "left")
    component = F.when(F.col("number").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_per_component(docs: DataFrame, words: int = 5, percent: int = 80, group_sets: int = 256) -> DataFrame:
    """``docs``, all columns, one row of each component: that with the smallest ``doc_id``, nulls last, then the smallest
    text hash, then the smallest hash of the row. Rows without words are linked to none and all stay."""
    own, named = _named_sets(docs, words, percent, group_sets)
    place = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "hash")
    first = own.join(named.select("number", "component"), "number").groupBy("component").agg(F.min(place).alias("first"))
    first = first.select(F.col("first.doc_id").alias("id"), F.col("first.hash").alias("hash")).distinct()
    wordless = docs["text"].isNull() | ~docs["text"].rlike(r"[^ \t\n\x0B\f\r]")
    rows = docs.where(~wordless).select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.xxhash64("row.text") == F.col("hash"))
    rows = rows.join(first, same, "left_semi")
    # Equal ids and texts: one row, combined in each task first.
    rows = rows.groupBy(F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("hash")).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return rows.select("row.*").unionByName(docs.where(wordless))


def _named_sets(docs: DataFrame, words: int, percent: int, group_sets: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, number, n, hash)`` of each row, ``number`` null without words, and ``(number, least, component)`` of each set."""
    spark = docs.sparkSession
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    rows = stored(texts.withColumn("hash", F.xxhash64("text")).mapInArrow(_sets_and_sketch(words), "kind int, doc_id long, hash long, number long, n long, chunk binary"))
    levels, hot = _sketch_levels(rows)
    levels = spark.sparkContext.broadcast(levels)
    own = rows.where("kind = 0").select("doc_id", "number", "n", "hash")

    total = own.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, int(total * (100 - percent + 10) / 100 / _BUCKET_TOKENS))
    packed = texts.select("text").mapInArrow(
        _token_rows(levels, hot, words, percent, buckets), "bucket long, tokens binary, owners binary, sizes binary, runs binary"
    )
    lists = stored(packed.groupBy("bucket").applyInArrow(_repeated, "token long, number long, n int, length int"))

    # Sets meet in the group of the longest list that they are in.
    info = lists.groupBy("number").agg(
        F.count("*").alias("shared"), F.max("n").alias("n"), F.max(F.struct("length", "token"))["token"].alias("lead")
    )
    least = F.greatest(F.lit(1), F.floor(F.floor(F.col("n") * percent / 100) / 10))
    # Fewer shared prefix shingles than any partner must have (a partner may be smaller by percent): no links.
    info = stored(info.where(F.col("shared") >= least).drop("shared"))
    sizes = info.groupBy("lead").agg(F.count("*").alias("sets"))
    part = F.pmod(F.xxhash64("number"), F.greatest(F.lit(1), F.ceil(F.col("sets") / group_sets)))
    group = stored(info.join(sizes, "lead").select("number", "n", "lead", F.xxhash64("lead", part).alias("group")))

    # Token-group matrix: which groups' unions hold a prefix shingle, and sizes there. Groups with one lead count as one.
    cells = lists.select("token", "number", "length").join(group.select("number", "n", "lead"), "number")
    place = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("length"), "token"))  # a set's own prefix
    cells = stored(cells.select("token", "number", "n", "lead", (place < least).alias("long")))
    discard(lists, info)
    matrix = cells.groupBy("token", "lead").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.count("*").alias("sets"))
    apart = (F.col("x.lead") < F.col("g.lead")) | ((F.col("x.lead") == F.col("g.lead")) & (F.col("g.sets") > 1))
    fits = apart & (100 * F.col("g.most") >= percent * F.col("x.n")) & (100 * F.col("x.n") >= percent * F.col("g.least"))
    met = cells.where("not long").alias("x").join(matrix.alias("g"), (F.col("x.token") == F.col("g.token")) & fits)
    met = stored(met.groupBy("x.number", "x.n", F.col("x.lead").alias("own_lead"), F.col("g.lead").alias("lead")).agg(F.count("*").alias("shared")))
    # Candidates that reach the bound already need no count of the longest lists, nor do those of a set's own lead, which holds all of them.
    counted = _counted_lists(cells, met.where((F.col("shared") < least) & (F.col("lead") != F.col("own_lead"))), matrix)
    met = met.join(counted, ["number", "lead"], "left")
    met = met.where((F.col("lead") == F.col("own_lead")) | (F.col("shared") + F.coalesce("more", F.lit(0)) >= least))
    met = met.select("number", "n", "lead").join(group.select("number", F.col("lead").alias("own_lead"), F.col("group").alias("own")), "number")
    spans = group.groupBy("lead", "group").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    fits = (100 * F.col("most") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("least"))
    ordered = (F.col("own_lead") != F.col("lead")) | (F.col("own") <= F.col("group"))
    opened = stored(met.join(spans, "lead").where(fits & ordered).select("number", "group"))
    discard(cells)

    # The sets of what is left, from their texts.
    wanted = opened.select("number").unionByName(
        opened.select("group").distinct().join(group.select("group", "number"), "group").select("number")
    ).distinct()
    chosen = own.join(wanted, "number").groupBy("number").agg(F.min("doc_id").alias("doc_id"))
    named = _finish(texts, own, chosen, opened, group, words, percent)
    discard(opened, group)
    return own, named


def _counted_lists(cells: DataFrame, open_: DataFrame, matrix: DataFrame) -> DataFrame:
    """``(number, lead, more)``: of the longest lists of each candidate in ``open_``, how many its group is in."""
    longest = cells.where("long").select("token", "number").join(open_.select("number", "lead"), "number")
    return longest.join(matrix.select("token", "lead"), ["token", "lead"]).groupBy("number", "lead").agg(F.count("*").alias("more"))


def _finish(texts, own, chosen, opened, group, words: int, percent: int) -> DataFrame:
    """``(number, least, component)`` of each set, with its smallest ``doc_id``."""

    def sets(batches):
        for batch in slices(batches):
            found = [shingle_set(t, words) for t in batch["text"].to_pylist()]
            numbers = pa.array([set_number(t) for t in found], pa.int64())
            yield pa.RecordBatch.from_arrays([numbers, pa.array([t.tobytes() for t in found], pa.binary())], ["number", "tokens"])

    by_id = texts.join(chosen.where("doc_id is not null").select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi").select("text")
    # Sets of which no row has an id are read by scanning the rows without one.
    nameless = texts.where("doc_id is null").select("text").mapInArrow(sets, "number long, tokens binary")
    nameless = nameless.join(chosen.where("doc_id is null").select("number"), "number", "left_semi")
    payload = stored(by_id.mapInArrow(sets, "number long, tokens binary").unionByName(nameless))

    queries = opened.join(payload, "number").select("number", "group", F.lit(1).alias("role"), "tokens")
    used = opened.groupBy("group").agg(F.ceil(F.count("*") / _QUERY_BLOCK).cast("int").alias("blocks"))
    queries = queries.join(used, "group").withColumn("block", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int"))
    members = group.join(used, "group").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.join(payload, "number").select("number", "group", "block", F.lit(0).alias("role"), "tokens")
    met = members.unionByName(queries.select("number", "group", "block", "role", "tokens"))
    links = met.groupBy("group", "block").applyInArrow(_opened(percent), "a long, b long")

    roots = connected_components(links)
    named = own.groupBy("number").agg(F.min("doc_id").alias("least"))
    named = named.where("number is not null").join(roots.withColumnRenamed("node", "number"), "number", "left")
    named = stored(named.select("number", "least", F.coalesce("component", "number").alias("component")))
    discard(payload)
    return named
