"""Prefix trie of conversations, its subtree totals by parallel tree contraction.

Each conversation is rebuilt from the first turns of its base and its own later turns; the distinct
prefixes of the rebuilt conversations are the nodes of a trie. Totals over subtrees come from a tree
contraction in join rounds: *rake* takes all childless nodes off and adds their totals to their
parents; *compress* takes nodes with one child out of the chains they lie in, every second one of a chain, and
leaves their own weight on the edge of the child. Each round is one aggregate and two joins over what is still there, so a
trie of depth ``d`` takes about ``log2(d)`` rounds instead of ``d``. The nodes taken out are put back at the end:
the total of each is that of the node below it plus what lay between; as that node may have been taken
out too, the links double their reach in each join.

Positions in a conversation and prefix keys are computed over range-sorted pieces, whose offsets are added
afterwards, so that one conversation may hold any share of the rows. A prefix is known by its depth and the exclusive or of
two 64-bit hashes of (position, turn), 128 bits in all: other prefixes of equal keys would count as one.

Nulls and odd rows: rows without ``conv_id`` are left out; a null role or text is empty; a null turn comes
first. Rows of a conversation with the same turn are ordered by the first 64 characters of the role, the first 256 of
the text, then by hash; repeated rows count as so many turns. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrante.llm.common import stored
from quadrante.operators.joins import lookup_join

#: Characters of the ids of one node that are handed on as one row.
CHUNK = 1 << 18
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
_NODE = ["conv_id", "depth"]


def _numbered(batches):
    """Sorted rows with their place among the rows of their conversation in this task."""
    piece = TaskContext.get().partitionId()
    last, count = None, 0
    for batch in batches:
        ids = batch["conv_id"].to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1 if ids[0] > 0 else ids[0] + 1))
        sizes = np.diff(starts, append=len(ids))
        local = np.arange(1, len(ids) + 1) - np.repeat(starts, sizes)
        if ids[0] == last:
            local[: sizes[0]] += count
        last, count = ids[-1], local[-1]
        pieces = pa.array(np.full(len(ids), piece), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch["conv_id"], pieces, pa.array(local, pa.int64()), batch["d1"], batch["d2"], batch["n_bytes"]],
            ["conv_id", "piece", "local", "d1", "d2", "n_bytes"],
        )


def _turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, piece, local, d1, d2, n_bytes``: turns in order, numbered in each piece, without their texts."""
    conv, turn, role, text = (conversations[c] for c in ("conv_id", "turn", "role", "text"))
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    rows = conversations.where(conv.isNotNull()).select(
        conv.cast("long").alias("conv_id"),
        turn.alias("turn"),
        F.substring(role, 1, 64).alias("r"),
        F.substring(text, 1, 256).alias("t"),
        F.xxhash64(F.lit(1), role, text).alias("d1"),
        F.xxhash64(F.lit(2), role, text).alias("d2"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = ["conv_id", "turn", "r", "t", "d1", "d2"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "d1", "d2", "n_bytes")
    return stored(ordered.mapInArrow(_numbered, "conv_id long, piece long, local long, d1 long, d2 long, n_bytes long"))


def _before(value: Column, conv: str, piece: str) -> Column:
    return value.over(Window.partitionBy(conv).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1))


def _rebuilt(conversations: DataFrame, modulus: int, most: int) -> tuple[DataFrame, DataFrame]:
    """``(conv_id, piece, depth, size, e1, e2, n_bytes)`` of each turn of the rebuilt conversations, ``size`` their turns,
    and ``(conv_id, size)`` of each. ``e1, e2`` are hashes of position and turn."""
    turns = _turns(conversations)
    pieces = turns.groupBy("conv_id", "piece").agg(F.max("local").alias("n"))
    offsets = pieces.select("conv_id", "piece", F.coalesce(_before(F.sum("n"), "conv_id", "piece"), F.lit(0)).alias("before"))
    placed = turns.join(offsets, ["conv_id", "piece"]).withColumn("place", F.col("before") + F.col("local"))

    lengths = pieces.groupBy("conv_id").agg(F.sum("n").alias("length"))
    own = lengths.select(
        "conv_id",
        "length",
        (F.col("conv_id") - F.col("conv_id") % modulus).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).alias("h"),
    )
    bases = lengths.where(F.col("conv_id") % modulus == 0).select(F.col("conv_id").alias("base"), F.col("length").alias("base_length"))
    taken = F.least("h", F.coalesce("base_length", F.lit(0)))
    plan = own.join(bases, "base", "left").select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("size"))
    plan = stored(plan)

    kept = lookup_join(placed, plan, ["conv_id"]).where("place > h")
    kept = kept.select("conv_id", "piece", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "size", "d1", "d2", "n_bytes")
    heads = placed.where((F.col("conv_id") % modulus == 0) & (F.col("place") <= most))
    heads = heads.select(F.col("conv_id").alias("base"), F.col("place").alias("depth"), "d1", "d2", "n_bytes")
    lent = heads.join(plan.where("taken > 0"), "base").where("depth <= taken")
    lent = lent.select("conv_id", F.lit(-1).cast("long").alias("piece"), "depth", "size", "d1", "d2", "n_bytes")
    rows = kept.unionByName(lent)
    hashes = [F.xxhash64(d, "depth").alias(e) for d, e in (("d1", "e1"), ("d2", "e2"))]
    return rows.select("conv_id", "piece", "depth", "size", *hashes, "n_bytes"), plan.select("conv_id", "size")


def _keyed(rebuilt: DataFrame) -> DataFrame:
    """``conv_id, depth, size, k1, k2, p1, p2, n_bytes``: keys of each prefix and of the one without its last turn."""
    running = Window.partitionBy("conv_id", "piece").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    totals = rebuilt.groupBy("conv_id", "piece").agg(F.bit_xor("e1").alias("t1"), F.bit_xor("e2").alias("t2"))
    before = totals.select(
        "conv_id", "piece", *(F.coalesce(_before(F.bit_xor(t), "conv_id", "piece"), F.lit(0)).alias(b) for t, b in (("t1", "b1"), ("t2", "b2")))
    )
    rows = rebuilt.select("*", F.bit_xor("e1").over(running).alias("x1"), F.bit_xor("e2").over(running).alias("x2"))
    rows = rows.join(before, ["conv_id", "piece"])
    keys = [F.col(f"x{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"k{i}") for i in (1, 2)]
    rows = rows.select("conv_id", "depth", "size", *keys, "e1", "e2", "n_bytes")
    parents = [F.col(f"k{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"p{i}") for i in (1, 2)]
    return stored(rows.select("conv_id", "depth", "size", "k1", "k2", *parents, "n_bytes"))


def _end_pieces(batches):
    """Rows sorted by node and conversation: the digest of each node that lies within this task, and the text of the
    ids, in rows of about ``CHUNK`` characters, of those that may not, and of long ones."""
    names = ["k1", "k2", "depth", "first", "sha", "ids"]
    out: list[tuple] = []
    key, first, texts, size, cut = None, None, [], 0, True  # cut: other rows of the node are elsewhere

    def flush(whole: bool) -> None:
        text = ",".join(texts)
        out.append((*key, first, hashlib.sha256(text.encode()).hexdigest() if whole else None, None if whole else text))

    def batch_of(rows):
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for *node, conv in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "depth", "conv_id"))):
            if node != key or size > CHUNK:
                if key is not None:
                    flush(not cut and node != key)
                    cut = node == key
                key, first, texts, size = node, conv, [], 0
            texts.append(str(conv))
            size += len(texts[-1]) + 1
        if len(out) > 2000 or sum(len(r[5] or "") for r in out) > CHUNK:
            yield batch_of(out)
            out.clear()
    if key is not None:
        flush(False)
    if out:
        yield batch_of(out)


def _joined_digests(batches):
    """Rows of one node next to each other and in order: the digest of their ids."""
    key, state, out = None, None, []

    def batch_of(rows):
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["k1", "k2", "depth", "sha"])

    for batch in batches:
        for *node, ids in zip(*(batch[c].to_pylist() for c in ("k1", "k2", "depth", "ids"))):
            if node == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = node, hashlib.sha256()
            state.update(ids.encode())
        if len(out) > 2000:
            yield batch_of(out)
            out.clear()
    if key is not None:
        out.append((*key, state.hexdigest()))
    if out:
        yield batch_of(out)


def end_digests(ends: DataFrame) -> DataFrame:
    """``k1, k2, depth, sha`` of the ids in each node of ``ends (k1, k2, depth, conv_id)``.

    A digest is a chain, so the ids of a node meet in one task at last, but as text in rows of ``CHUNK`` characters that stream past.
    """
    order = ["k1", "k2", "depth", "conv_id"]
    ordered = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = stored(ordered.mapInArrow(_end_pieces, "k1 long, k2 long, depth long, first long, sha string, ids string"))
    node = ["k1", "k2", "depth"]
    cut = pieces.where("sha is null").repartition(*node).sortWithinPartitions(*node, "first")
    joined = cut.select(*node, "ids").mapInArrow(_joined_digests, "k1 long, k2 long, depth long, sha string")
    return pieces.where("sha is not null").select(*node, "sha").unionByName(joined)


def _rake(alive: DataFrame) -> DataFrame:
    """Nodes that have children, with the totals of their childless ones added; the latter are gone."""
    given = alive.where("kids = 0 and p_conv is not null")
    given = given.groupBy(F.col("p_conv").alias("conv_id"), F.col("p_depth").alias("depth")).agg(
        F.sum(F.col("leaves") + F.col("edge_leaves")).alias("g_leaves"),
        F.sum(F.col("saved") + F.col("edge_saved")).alias("g_saved"),
        F.count("*").alias("gone"),
    )
    rest = lookup_join(alive.where("kids > 0"), given, _NODE, "left")
    zero = F.lit(0)
    return rest.select(
        *_NODE,
        "p_conv",
        "p_depth",
        (F.col("leaves") + F.coalesce("g_leaves", zero)).alias("leaves"),
        (F.col("saved") + F.coalesce("g_saved", zero)).alias("saved"),
        "edge_leaves",
        "edge_saved",
        (F.col("kids") - F.coalesce("gone", zero)).alias("kids"),
    )


def _compress(alive: DataFrame, bit: int) -> DataFrame:
    """Takes out nodes with one child, of which a bit of the depth is 1 and that of the parent's depth is 0, so never two in a row.

    ``out`` marks them. Their children get their parents, the weights left on the edges, and the link by which they come back:
    ``u_conv, u_depth``, and ``u_leaves, u_saved``, what lay between them and the child.
    """
    odd = lambda column: F.shiftright(F.col(column), bit).bitwiseAND(F.lit(1)) == 1
    marked = alive.withColumn("out", F.coalesce((F.col("kids") == 1) & odd("depth") & ~odd("p_depth"), F.lit(False)))
    taken = marked.where("out").select(
        F.col("conv_id").alias("p_conv"),
        F.col("depth").alias("p_depth"),
        F.col("p_conv").alias("g_conv"),
        F.col("p_depth").alias("g_depth"),
        F.col("leaves").alias("w_leaves"),
        F.col("saved").alias("w_saved"),
        F.col("edge_leaves").alias("w_edge_leaves"),
        F.col("edge_saved").alias("w_edge_saved"),
    )
    # Only the root has no parent; it joins with nothing.
    joined = lookup_join(marked, taken, ["p_conv", "p_depth"], "left")
    linked, zero = F.col("g_conv").isNotNull(), F.lit(0)
    return joined.select(
        *_NODE,
        F.coalesce("g_conv", "p_conv").alias("p_conv"),
        F.coalesce("g_depth", "p_depth").alias("p_depth"),
        "leaves",
        "saved",
        *((F.col(f"edge_{x}") + F.coalesce(f"w_{x}", zero) + F.coalesce(f"w_edge_{x}", zero)).alias(f"edge_{x}") for x in ("leaves", "saved")),
        "kids",
        "out",
        F.when(linked, F.col("p_conv")).alias("u_conv"),
        F.when(linked, F.col("p_depth")).alias("u_depth"),
        *((F.col(f"edge_{x}") + F.col(f"w_{x}")).alias(f"u_{x}") for x in ("leaves", "saved")),
    )


def subtree_totals(tree: DataFrame) -> DataFrame:
    """``conv_id, depth, leaves, saved``: sums over the subtree of each node of
    ``tree (conv_id, depth, p_conv, p_depth, kids, leaves, saved)``, where depths grow downwards and the root has no parent."""
    zero = F.lit(0).cast("long")
    state = tree.select(
        *_NODE,
        "p_conv",
        "p_depth",
        *(F.col(c).cast("long").alias(c) for c in ("leaves", "saved")),
        zero.alias("edge_leaves"),
        zero.alias("edge_saved"),
        F.col("kids").cast("long").alias("kids"),
        F.lit(False).alias("out"),
    )
    state = stored(state)
    bits = max(1, int(state.agg(F.max("depth")).first()[0] or 0).bit_length())
    done, links, rounds = [], [], 0
    while True:
        alive = state.where("not out")
        done.append(alive.where("kids = 0").select(*_NODE, "leaves", "saved"))
        if alive.where("kids > 0").isEmpty():
            break
        state = stored(_compress(_rake(alive.drop("out", *(c for c in alive.columns if c.startswith("u_")))), rounds % bits))
        links.append(state.where("u_conv is not null").select(*_NODE, *(F.col(f"u_{x}") for x in ("conv", "depth", "leaves", "saved"))))
        rounds += 1
    totals = done[0]
    for part in done[1:]:
        totals = totals.unionByName(part)
    if not links:
        return totals
    back = links[0]
    for part in links[1:]:
        back = back.unionByName(part)
    back = stored(back)
    while True:  # conv_id, depth: the node below; it may have been taken out in a later round
        further = back.select(
            F.col("u_conv").alias("conv_id"), F.col("u_depth").alias("depth"),
            F.col("conv_id").alias("b_conv"), F.col("depth").alias("b_depth"), F.col("u_leaves").alias("b_leaves"), F.col("u_saved").alias("b_saved"),
        )
        joined = lookup_join(back, further, _NODE, "left").select(
            F.coalesce("b_conv", "conv_id").alias("conv_id"),
            F.coalesce("b_depth", "depth").alias("depth"),
            "u_conv",
            "u_depth",
            *((F.col(f"u_{x}") + F.coalesce(f"b_{x}", F.lit(0))).alias(f"u_{x}") for x in ("leaves", "saved")),
            F.col("b_conv").isNotNull().alias("moved"),
        )
        joined = stored(joined)
        back = joined.drop("moved")
        if joined.where("moved").isEmpty():
            break
    returned = lookup_join(back, totals, _NODE).select(
        F.col("u_conv").alias("conv_id"),
        F.col("u_depth").alias("depth"),
        (F.col("leaves") + F.col("u_leaves")).alias("leaves"),
        (F.col("saved") + F.col("u_saved")).alias("saved"),
    )
    return totals.unionByName(returned)


def conversation_trie(conversations: DataFrame, modulus: int = 5, most: int = 8) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % modulus`` and goes on with its own after
    its first ``h``; ``h`` is the CRC-32 of the decimal ``c`` modulo ``most + 1``.
    """
    rebuilt, sizes = _rebuilt(conversations, modulus, most)
    keyed = _keyed(rebuilt)
    node = ["k1", "k2", "depth"]
    prefixes = keyed.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("n_bytes").alias("n_bytes")
    )
    zero = F.lit(0).cast("long")
    root = sizes.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), *root.columns, zero.alias("p1"), zero.alias("p2"), zero.alias("n_bytes"))
    prefixes = stored(prefixes.unionByName(root))
    parents = prefixes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("depth").alias("p_depth"), F.col("conv_id").alias("p_conv"))
    below = prefixes.withColumn("p_depth", F.col("depth") - 1)
    nodes = lookup_join(below, parents, ["p1", "p2", "p_depth"], "left")
    nodes = stored(nodes.select(*node, "conv_id", "n_convs", "n_bytes", "p_conv", F.when(F.col("p_conv").isNotNull(), F.col("p_depth")).alias("p_depth")))

    children = nodes.where("p_conv is not null").groupBy(F.col("p_conv").alias("conv_id"), F.col("p_depth").alias("depth")).agg(F.count("*").alias("kids"))
    ends = keyed.where("depth = size").select(*node, "conv_id").unionByName(sizes.where("size = 0").select(zero.alias("k1"), zero.alias("k2"), zero.alias("depth"), "conv_id"))
    nodes = nodes.join(children, _NODE, "left").join(end_digests(ends), node, "left")
    nodes = nodes.select(
        *_NODE, "p_conv", "p_depth", "n_convs", F.coalesce("kids", zero).alias("kids"), F.coalesce("sha", F.lit(EMPTY_SHA256)).alias("ends_sha256"), "n_bytes"
    )
    nodes = stored(nodes)
    tree = nodes.select(
        *_NODE, "p_conv", "p_depth", "kids",
        F.when(F.col("kids") == 0, 1).otherwise(0).alias("leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
    )
    return nodes.join(subtree_totals(tree), _NODE).select(
        "conv_id",
        "depth",
        F.col("p_conv").alias("parent_conv_id"),
        "n_convs",
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        "ends_sha256",
    )
