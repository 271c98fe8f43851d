"""Removal of byte strings of ``length`` that start in two places, by deep-shallow sorting of sampled suffixes.

* Suffixes are sampled by content: a position counts if the hash of its first ``gram`` bytes is the smallest among the starts
  in some string of ``length`` bytes. Equal strings hold their sampled positions at equal places, so two equal strings always
  meet in two sampled suffixes with the same first bytes. Suffixes whose first bytes stand nowhere else drop out.
* Of the others, those with the same ``length`` bytes to the right and as many to the left as a string can reach are copies of
  one another, known from a hash; they are counted, and one stays for all.
* What is left of one gram is sorted: multikey quicksort by single bytes down to a shallow depth, then blind tries for the groups
  that still share their prefix. The order and its common prefixes give the nodes of the suffix tree. In a node of depth ``r``
  each suffix has ``r`` bytes to the right in common with the others; its longest common extension ``l`` to the left is that with
  a neighbour in the order of the reversed left sides. With ``l + r >= length`` the bytes from ``l`` before to ``r`` behind the
  position stand elsewhere too.
* A gram with more than ``group`` different surroundings is not gathered: its strings are grouped by 128-bit hashes.

Texts are known by 96 bits of hash, surroundings by 64 bits next to the gram's 64. Rows of equal text count as so many texts.

Nulls and odd rows: a null text is empty; texts shorter than ``length`` stay; matches never cross texts; each row gets its result,
whatever its id; no rows, no result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrante.llm.common import slices, stored
from quadrante.operators.joins import lookup_join

LENGTH = 200
GRAM = 48
#: Bytes to which suffixes are sorted byte by byte.
SHALLOW = 64
#: Different surroundings of one gram that are sorted in one group.
GROUP = 20_000
_CHUNK = 1 << 20
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash, above zero, of the ``gram`` bytes from each position on; built from powers of two by doubling."""
    mix = lambda h: (h ^ (h >> np.uint64(31))) * _M2
    n = len(data) - gram + 1
    power = mix((data.astype(np.uint64) + np.uint64(1)) * _M1)
    out, at, size = np.zeros(n, np.uint64), 0, 1
    while True:
        if gram & size:
            out = mix(out ^ power[at : at + n]) + np.uint64(size)
            at += size
        size *= 2
        if size > gram:
            break
        power = mix(power[: -size // 2]) + (power[size // 2 :] ^ (power[size // 2 :] >> np.uint64(29)))
    out = (out ^ (out >> np.uint64(32))) * _M1
    return (out ^ (out >> np.uint64(29))) | np.uint64(1)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from block prefixes and suffixes."""
    n = len(values) - width + 1
    rows = np.resize(values, -(-len(values) // width) * width)
    rows[len(values) :] = values[-1]
    rows = rows.reshape(-1, width)
    up = np.minimum.accumulate(rows, axis=1).ravel()
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[:n], up[width - 1 : width - 1 + n])


def sampled(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions of texts that lie one after the other in ``data`` and end at ``ends``, and their hashes: in each string
    the first of those with the smallest upper bits of the hash."""
    width, bits = length - gram + 1, (_CHUNK + length).bit_length()
    low_bits = np.uint64((1 << bits) - 1)
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for low in range(0, max(0, len(data) - length + 1), _CHUNK):
        high = min(low + _CHUNK, len(data) - length + 1)
        own = gram_hashes(data[low : high - 1 + length], gram)
        least = sliding_least((own & ~low_bits) | np.arange(len(own), dtype=np.uint64), width)
        starts = np.arange(low, high)
        least = least[starts + length <= ends[np.searchsorted(ends, starts, side="right")]]
        # The place of the first smallest one does not fall from one string to the next unless a smaller one comes in.
        chosen = np.unique(least[np.flatnonzero(np.diff(least, prepend=~least[:1]))] & low_bits).astype(np.int64)
        places.append(chosen + low)
        hashes.append(own[chosen])
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def _packed(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    parts = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
    return b"".join(parts), np.cumsum([len(p) for p in parts])


def _grams(length: int, gram: int):
    def run(batches):
        for batch in slices(batches, 128):
            data, ends = _packed(batch["text"])
            hashes = sampled(np.frombuffer(data, np.uint8), ends, length, gram)[1]
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64))], ["gram"])

    return run


def _places(length: int, gram: int):
    """``gram, around, t1, tp, n``: hash of the surroundings; text key; half a text key and position; neighbours alike."""
    left = length - gram

    def run(batches):
        for batch in slices(batches, 128):
            data, ends = _packed(batch["text"])
            at, hashes = sampled(np.frombuffer(data, np.uint8), ends, length, gram)
            text = np.searchsorted(ends, at, side="right")
            starts = np.concatenate([[0], ends])[text]
            low, high = np.maximum(starts, at - left), np.minimum(ends[text], at + length)
            digest = xxhash.xxh3_64_intdigest
            # A seed tells surroundings apart that are cut off by an end of the text.
            around = np.fromiter(
                (digest(data[a:b], seed) for a, b, seed in zip(low.tolist(), high.tolist(), ((at - low) * (length + 1) + high - at).tolist())), np.uint64, len(at)
            )
            new = np.ones(len(at), bool)
            if len(at):
                new[1:] = (hashes[1:] != hashes[:-1]) | (around[1:] != around[:-1]) | (text[1:] != text[:-1]) | (np.diff(at) > 1)
            head = np.flatnonzero(new)
            t1, t2 = (batch[c].to_numpy()[text[head]] for c in ("t1", "t2"))
            packed = (t2 << 32) | (at - starts)[head]
            alike = np.diff(head, append=len(at)).astype(np.int32)
            arrays = [hashes.view(np.int64)[head], around.view(np.int64)[head], t1, packed, alike]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["gram", "around", "t1", "tp", "n"])

    return run


def _compressed(batches):
    coder = zstandard.ZstdCompressor(level=1)
    for batch in slices(batches):
        texts = pa.array([coder.compress(t or b"") for t in batch["text"].cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "text"), texts], [*(c for c in batch.schema.names if c != "text"), "data"])


def _surroundings(length: int, gram: int):
    """``gram, around, done, hot, back, right`` of the wanted positions; ``back``: the left side, reversed."""
    left = length - gram
    names = ["gram", "around", "done", "hot", "back", "right"]

    def run(batches):
        coder = zstandard.ZstdDecompressor()
        for batch in slices(batches, 64):
            rows: list[tuple] = []
            for raw, wanted in zip(batch["data"].to_pylist(), batch["wanted"].to_pylist()):
                text = coder.decompress(raw)
                for w in wanted:
                    p = w["place"]
                    rows.append((w["gram"], w["around"], w["done"], w["hot"], text[max(0, p - left) : p][::-1], text[p : p + length]))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def common_prefix(a: bytes, b: bytes, low: int = 0) -> int:
    """Length of the common prefix; the first ``low`` bytes are known to be equal."""
    high = min(len(a), len(b))
    if a[low:high] == b[low:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


class BlindTrie:
    """Strings by the bytes at which they part. A search looks at these bytes only, so it may end at any leaf; one comparison with
    that leaf tells where the string belongs."""

    def __init__(self, strings: list[bytes], depth: int) -> None:
        self.strings, self.depth = strings, depth
        self.root: list | None = None  # a leaf: [None, rows]; a node: [depth, {byte: below}]

    def insert(self, row: int) -> None:
        text = self.strings[row]
        if self.root is None:
            self.root = [None, [row]]
            return
        at = self.root
        while at[0] is not None:
            key = text[at[0]] if at[0] < len(text) else -1
            at = at[1].get(key) or next(iter(at[1].values()))
        other = self.strings[at[1][0]]
        shared = common_prefix(text, other, self.depth)
        if shared == len(text) == len(other):
            at[1].append(row)
            return
        parent, key, at = None, None, self.root
        while at[0] is not None and at[0] < shared:
            parent, key = at, text[at[0]] if at[0] < len(text) else -1
            at = at[1][key]
        mine = text[shared] if shared < len(text) else -1
        if at[0] == shared:
            at[1][mine] = [None, [row]]
            return
        theirs = other[shared] if shared < len(other) else -1
        node = [shared, {mine: [None, [row]], theirs: at}]
        if parent is None:
            self.root = node
        else:
            parent[1][key] = node

    def walk(self) -> tuple[list[int], list[int]]:
        """Rows in order, and the common prefix of each with the one before (0 for the first)."""
        order, shared = [], []
        stack = [(self.root, 0)] if self.root else []
        while stack:
            at, with_before = stack.pop()
            if at[0] is None:
                order.extend(at[1])
                shared.append(with_before)
                shared.extend([len(self.strings[at[1][0]])] * (len(at[1]) - 1))
            else:
                keys = sorted(at[1])
                stack.extend((at[1][k], at[0] if i else with_before) for i, k in reversed(list(enumerate(keys))))
        return order, shared


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Rows of ``strings`` in order, and the common prefix of each with the one before (0 for the first).

    Multikey quicksort splits by the byte behind what a group has in common; from ``shallow`` bytes on a blind trie takes over.
    """
    order: list[int] = []
    shared: list[int] = []
    stack = [(list(range(len(strings))), 0, 0)]  # rows, known depth, common prefix with what comes before
    while stack:
        rows, depth, before = stack.pop()
        if len(rows) == 1:
            order.append(rows[0])
            shared.append(before)
            continue
        if not rows:
            continue
        if depth < shallow:
            group = [strings[k] for k in rows]
            low, high = min(group), max(group)
            if low == high:
                order.extend(rows)
                shared.extend([before, *[len(low)] * (len(rows) - 1)])
                continue
            depth = common_prefix(low, high, depth)
        if depth >= shallow:
            trie = BlindTrie(strings, depth)
            for k in rows:
                trie.insert(k)
            part, within = trie.walk()
            order.extend(part)
            shared.extend([before, *within[1:]])
            continue
        keys = [strings[k][depth] if len(strings[k]) > depth else -1 for k in rows]
        pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        parts = [[k for k, b in zip(rows, keys) if test(b)] for test in (lambda b: b < pivot, lambda b: b == pivot, lambda b: b > pivot)]
        steps = [(p, depth) for p in parts if p]  # how much more they share is seen when their turn comes
        stack.extend((p, d, depth if i else before) for i, (p, d) in reversed(list(enumerate(steps))))
    return order, shared


def nodes(shared: list[int], size: int):
    """``(depth, first, last)`` of the nodes of the suffix tree above sorted rows, two rows at least each."""
    stack: list[tuple[int, int]] = []
    for k in range(1, size + 1):
        depth, first = (shared[k] if k < size else -1), k - 1
        while stack and stack[-1][0] > depth:
            below, first = stack.pop()
            yield below, first, k - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def extensions(rights: list[bytes], backs: list[bytes], length: int) -> list[tuple[int, int]]:
    """For each suffix the bytes to the left and to the right of it that stand with another of the group, (0, 0) if no
    ``length`` of them do."""
    if len(rights) == 2:
        both = (common_prefix(*backs), common_prefix(*rights))
        return [both if sum(both) >= length else (0, 0)] * 2
    order, shared = deep_shallow(rights)
    by_left, shared_left = deep_shallow(backs)
    rank = [0] * len(backs)
    for place, k in enumerate(by_left):
        rank[k] = place
    most = max(map(len, backs), default=0)
    best = [(0, 0)] * len(rights)
    for depth, first, last in nodes(shared, len(order)):
        if depth + most < length:
            continue
        members = sorted((order[k] for k in range(first, last + 1)), key=rank.__getitem__)
        near = [common_prefix(backs[a], backs[b]) for a, b in zip(members, members[1:])]
        for k, before, behind in zip(members, [0, *near], [*near, 0]):
            left = max(before, behind)
            if left + depth >= length:
                best[k] = (max(best[k][0], left), max(best[k][1], depth))
    return best


def _sorted_groups(length: int):
    """Surroundings in the order of their grams: ``gram, around, l, r`` of those that stand elsewhere too."""
    names = ["gram", "around", "l", "r"]

    def run(batches):
        out: list[tuple] = []

        def close(gram, rows):
            found = extensions([r[3] for r in rows], [r[2] for r in rows], length)
            out.extend((gram, around, *lr) for (around, done, *_), lr in zip(rows, found) if lr[1] and not done)

        gram, rows = None, []
        for batch in batches:
            for g, *row in zip(*(batch[c].to_pylist() for c in ("gram", "around", "done", "back", "right"))):
                if g != gram:
                    if len(rows) > 1:
                        close(gram, rows)
                    gram, rows = g, []
                rows.append(row)
            if len(out) > 5000:
                yield table(out)
                out.clear()
        if len(rows) > 1:
            close(gram, rows)
        if out:
            yield table(out)

    def table(rows):
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def _strings(length: int):
    """``gram, around, l, w1, w2``: hashes of all strings of ``length`` bytes around positions of very frequent grams."""

    def run(batches):
        for batch in slices(batches, 256):
            grams, arounds, lefts, digests = [], [], [], []
            for g, a, back, right in zip(*(batch[c].to_pylist() for c in ("gram", "around", "back", "right"))):
                text, here = back[::-1] + right, len(back)
                reach = range(max(0, length - len(right)), len(back) + 1)
                grams += [g] * len(reach)
                arounds += [a] * len(reach)
                lefts += reach
                digests += [xxhash.xxh3_128_digest(text[here - n : here - n + length]) for n in reach]
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            arrays = [pa.array(grams, pa.int64()), pa.array(arounds, pa.int64()), pa.array(lefts, pa.int32()), *(pa.array(np.ascontiguousarray(halves[:, k])) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(arrays, ["gram", "around", "l", "w1", "w2"])

    return run


def repeats(texts: DataFrame, length: int, gram: int, group: int) -> DataFrame:
    """``t1, t2, found``: of each text of ``texts (t1, t2, text)`` the sampled positions near which strings stand elsewhere too, as
    structs ``place, n, l, r``."""
    long = texts.where(F.octet_length("text") >= length)
    counts = long.select("text").mapInArrow(_grams(length, gram), "gram long").groupBy("gram").agg(F.count("*").alias("times"))
    places = long.select("t1", "t2", "text").mapInArrow(_places(length, gram), "gram long, around long, t1 long, tp long, n int")
    held = stored(lookup_join(places, counts.where("times > 1").select("gram"), ["gram"], "left_semi"))

    alike = held.groupBy("gram", "around").agg(F.sum("n").alias("times"), F.min(F.struct("t1", "tp")).alias("at"))
    alike = stored(alike.select("gram", "around", (F.col("times") > 1).alias("done"), "at.t1", "at.tp"))
    # Nothing is asked of a gram of one surrounding, or of which each surrounding has a copy.
    kinds = alike.groupBy("gram").agg(F.count("*").alias("kinds"), F.bool_and("done").alias("known")).where("kinds > 1 and not known").drop("known")
    wanted = lookup_join(alike, kinds, ["gram"])
    place = F.col("tp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("place")
    half = F.shiftrightunsigned("tp", 32).alias("t2")
    wanted = wanted.select("t1", half, F.struct("gram", "around", "done", place).alias("w"), (F.col("kinds") > group).alias("hot"))
    wanted = wanted.groupBy("t1", "t2").agg(F.collect_list(F.struct("w.*", "hot")).alias("wanted"))  # of one text

    packed = long.select("t1", "t2", "text").mapInArrow(_compressed, "t1 long, t2 long, data binary")
    packed = packed.groupBy("t1", "t2").agg(F.first("data").alias("data"))  # equal texts of one key
    both = packed.join(wanted, ["t1", "t2"]).select("data", "wanted")
    around = stored(both.mapInArrow(_surroundings(length, gram), "gram long, around long, done boolean, hot boolean, back binary, right binary"))

    cold = around.where("not hot").drop("hot").repartition("gram").sortWithinPartitions("gram")
    found = cold.mapInArrow(_sorted_groups(length), "gram long, around long, l int, r int")
    strings = around.where("hot").mapInArrow(_strings(length), "gram long, around long, l int, w1 long, w2 long")
    string = ["gram", "l", "w1", "w2"]
    twice = strings.groupBy(*string).agg(F.count("*").alias("times")).where("times > 1").select(*string)
    hits = lookup_join(strings, twice, string, "left_semi").groupBy("gram", "around").agg(F.max("l").alias("l"), (F.lit(length) - F.min("l")).alias("r"))
    copies = alike.where("done").select("gram", "around", F.lit(length - gram).alias("l"), F.lit(length).alias("r"))
    reach = found.unionByName(hits).unionByName(copies)
    spans = lookup_join(held, reach, ["gram", "around"]).select("t1", half, F.struct(place, "n", "l", "r").alias("s"))
    return spans.groupBy("t1", "t2").agg(F.collect_list("s").alias("found"))  # of one text


def merged_spans(found: pa.ListArray, sizes: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """Of each text, of so many bytes, the maximal runs ``[start, end)`` that go, from the extensions around positions."""
    counts = np.array(found.value_lengths().fill_null(0), np.int64)
    text = np.repeat(np.arange(len(sizes)), counts)
    values = found.flatten()
    place, n, left, right = (values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("place", "n", "l", "r"))
    low, high = np.maximum(0, place - left), np.minimum(sizes[text], place + right)
    held = np.flatnonzero(high - low >= length)
    base = np.cumsum(sizes + 1) - (sizes + 1)  # texts lie behind one another, one byte apart
    low, high, text = (low + base[text])[held], (high + n - 1 + base[text])[held], text[held]
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    first = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]])) if len(low) else np.zeros(0, np.int64)
    starts, ends = low[first], high[np.append(first[1:], len(low)) - 1] if len(low) else low
    owner = np.searchsorted(base, starts, side="right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(sizes))]
    for k, a, b in zip(owner.tolist(), (starts - base[owner]).tolist(), (ends - base[owner]).tolist()):
        out[k].append((a, b))
    return out


def remove_repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, with ``with_text``, ``spans`` (byte ranges
    ``[start, end)`` that go) and ``kept`` (the bytes that stay).

    Each byte within a string of ``length`` bytes that also starts anywhere else goes, its first occurrence too.
    """
    if not 1 < gram <= length:
        raise ValueError(f"a gram of {gram} bytes is not within a string of {length}")
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"))
    keys = [F.xxhash64(F.lit(1), "text").alias("t1"), F.shiftrightunsigned(F.xxhash64(F.lit(2), "text"), 32).alias("t2")]
    rows = rows.select("doc_id", *keys, "text")
    found = repeats(rows.select("t1", "t2", "text"), length, gram, group)
    packed = rows.mapInArrow(_compressed, "doc_id long, t1 long, t2 long, data binary")
    joined = lookup_join(packed, found, ["t1", "t2"], "left").select("doc_id", "data", "found")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["spans", "kept"] if with_text else [])]

    def run(batches):
        coder = zstandard.ZstdDecompressor()
        for batch in slices(batches, 128):
            out = []
            texts = [coder.decompress(raw) for raw in batch["data"].to_pylist()]
            gone = merged_spans(batch["found"], np.array([len(t) for t in texts], np.int64), length)
            for data, spans in zip(texts, gone):
                edges = [0, *(x for s in spans for x in s), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                row = (len(data), len(data) - len(kept), len(spans), hashlib.sha256(kept).hexdigest())
                out.append((*row, [{"start": a, "end": b} for a, b in spans], kept) if with_text else row)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], names)

    more = ", spans array<struct<start:long,end:long>>, kept binary" if with_text else ""
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + more)
