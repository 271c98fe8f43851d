"""Packing documents into token sequences along a space-filling curve.

A document's token counts are hashed to 256 buckets, damped and scaled to a unit vector, and projected
to four dimensions by a fixed random matrix. The projections, cut to 12 bits each, give the place of the
document on a Hilbert curve. Documents are range-sorted by that place, and each range is one stream of ids
cut every ``size`` ids: neighbours on the curve share sequences, and nothing is padded within a
stream. What is left at the end of a range is cut into sequences whose lengths are powers of two, which
need no padding either.

A document is encoded once and stored; one shuffle of the ids follows. Ties on the curve (copies, short
documents) are ordered, and split between tasks, by ``(doc_id, seq)``. A task holds one sequence beyond its
Arrow batches.

Defined results: a null or empty text is packed as its end id alone; equal rows are packed each; a null
``doc_id`` stays null in its pieces; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrante.llm.tokens import WORDS, crc_of_ids, tokenized

DIMENSIONS, BITS, BUCKETS = 4, 12, 256
_COUNTED = 1 << 18  # ids that are counted at once, about


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of the rows of ``cells`` (unsigned, below ``2**bits``), by Gray-code unfolding."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where(x[n - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_places(ids: list[np.ndarray]) -> np.ndarray:
    """Hilbert key of each document's ids."""
    projection = np.random.default_rng(11).standard_normal((BUCKETS, DIMENSIONS))
    vectors = np.zeros((len(ids), BUCKETS))
    sizes = np.array([len(own) for own in ids])
    # One count for many documents: a cell for each document and bucket.
    cuts = np.unique(np.searchsorted(np.cumsum(sizes), np.arange(0, sizes.sum() + _COUNTED, _COUNTED)))
    for a, b in zip([0, *cuts], [*cuts, len(ids)]):
        if a < b:
            hashed = (np.concatenate(ids[a:b]).astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(24)
            hashed += np.repeat(np.arange(b - a, dtype=np.uint32) << np.uint32(8), sizes[a:b])
            vectors[a:b] = np.bincount(hashed, minlength=BUCKETS * (b - a)).reshape(-1, BUCKETS)
    vectors = np.sqrt(vectors)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    spread = (vectors - vectors.mean(axis=1, keepdims=True)) @ projection
    top = (1 << BITS) - 1
    cells = np.clip((spread + 3) / 6 * top, 0, top).astype(np.int64)
    return hilbert_keys(cells)


class _Packer:
    """Cuts a stream of documents; ``pieces`` are those of sequences that are closed."""

    def __init__(self, size: int, base: int, width: int) -> None:
        self.size, self.next, self.type = size, base, f"<u{width}"
        self.open: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self.room = size
        self.pieces: list[tuple] = []

    def add(self, doc_id: int | None, raw: memoryview) -> None:
        ids = np.frombuffer(raw, self.type)
        start = 0
        while start < len(ids):
            part = ids[start : start + self.room]
            self.open.append((doc_id, start, part, len(ids)))
            start += len(part)
            self.room -= len(part)
            if not self.room:
                self._close(self.open)
                self.open, self.room = [], self.size

    def end(self) -> None:
        left = self.size - self.room
        while left:
            length = 1 << (left.bit_length() - 1)
            head, room = [], length
            while room:
                doc_id, start, part, total = self.open.pop(0)
                head.append((doc_id, start, part[:room], total))
                if len(part) > room:
                    self.open.insert(0, (doc_id, start + room, part[room:], total))
                room -= len(head[-1][2])
            self._close(head)
            left -= length
        self.room = self.size

    def _close(self, parts: list[tuple]) -> None:
        offset = 0
        for doc_id, start, part, total in parts:
            self.pieces.append((doc_id, start, len(part), crc_of_ids(part), total, self.next, offset, part))
            offset += len(part)
        self.next += 1


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048, with_ids: bool = True, words: int = WORDS) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with
    ``with_ids``, the piece's ``ids`` (array of int). Sequences have ``size`` ids or a power of two below it. ``words``:
    see ``tokenized``."""
    if size < 1 or size & (size - 1):
        raise ValueError(f"size must be a power of two, not {size}")
    places = lambda ids: [pa.array(curve_places(ids), pa.int64())]
    tokens = tokenized(docs, tokenizer_path, end_id, places, ", x0 long", words)
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer_path).get_vocab_size() <= 1 << 16 else 4
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def out(pieces):
        columns = list(zip(*pieces))
        arrays = [pa.array(columns[k], pa.int64()) for k in range(7)]
        if with_ids:
            arrays.append(pa.array([p.astype(np.int32) for p in columns[7]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, [*names, *(["ids"] if with_ids else [])])

    def cut(batches):
        packer = _Packer(size, TaskContext.get().partitionId() << 40, width)
        for batch in batches:
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["ids"]):
                packer.add(doc_id, raw.as_buffer())
                if len(packer.pieces) >= 5000:
                    yield out(packer.pieces)
                    packer.pieces = []
        packer.end()
        if packer.pieces:
            yield out(packer.pieces)

    schema = ", ".join(f"`{n}` long" for n in names) + (", ids array<int>" if with_ids else "")
    ordered = tokens.repartitionByRange("x0", "doc_id", "seq").sortWithinPartitions("x0", "doc_id", "seq")
    return ordered.select("doc_id", "ids").mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """The sequences themselves: ``sequence_id, ids, doc_ids, length``. A group is one sequence, so it is bounded."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.flatten("parts.ids")
    return rows.select("sequence_id", ids.alias("ids"), F.col("parts.doc_id").alias("doc_ids"), F.size(ids).alias("length"))
