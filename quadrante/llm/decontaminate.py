"""Benchmark decontamination: find windows of benchmark words in documents, remove them.

The distinct word windows of the benchmark go to every executor as a hash set. Its size is measured
first: a set over ``block_grams`` windows is split by hash into blocks of at most about that many, and the
documents are scanned once for each block, so no broadcast grows with the benchmark. A scan is a narrow
step over the documents, without a shuffle: it maps words to the benchmark's vocabulary, hashes the
windows that lie wholly in the vocabulary, looks them up and verifies hits word by word.

Words are maximal runs of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z.
Defined results: a null or wordless text has no words and no hits; a null or wordless item has no
windows; an item of fewer than ``n`` words is one window; an item with a null id marks words but is not
listed; repeated rows of either table give the same result each; extra columns are ignored by ``scan``
and kept by ``decontaminate``.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrante.llm.common import slices, stored

#: ASCII letters to lower case, ASCII digits and bytes beyond ASCII kept, the rest to blanks.
_FOLD = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20
    for b in range(256)
)
_RUN = re.compile(rb"[^ ]+")
_ODD = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64) for k in range(64)]


def words(text: bytes | None) -> list[bytes]:
    """The normalised words of a text in UTF-8."""
    return text.translate(_FOLD).split() if text else []


def benchmark_grams(benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Distinct ``(gram binary, size int, item string)``: words of each window joined by blanks."""

    def cut(batches):
        for batch in batches:
            grams, sizes, items = [], [], []
            for item, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist()):
                found = words(text)
                size = min(n, len(found))
                for k in range(len(found) - size + 1 if found else 0):
                    grams.append(b" ".join(found[k : k + size]))
                    sizes.append(size)
                    items.append(item)
            yield pa.RecordBatch.from_arrays(
                [pa.array(grams, pa.binary()), pa.array(sizes, pa.int32()), pa.array(items, pa.string())],
                ["gram", "size", "item"],
            )

    items = benchmark.select(benchmark["item_id"].cast("string").alias("item"), benchmark["text"].cast("binary").alias("text"))
    return items.mapInArrow(cut, "gram binary, size int, item string").distinct()


class GramSet:
    """A block of windows: vocabulary, and by window size the sorted hashes and the items of each window."""

    def __init__(self, rows) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[bytes, set[str]] = {}
        by_size: dict[int, list[np.ndarray]] = {}
        for row in rows:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in bytes(row["gram"]).split(b" ")], np.int32)
            key = ids.tobytes()
            if key not in self.items:
                self.items[key] = set()
                by_size.setdefault(row["size"], []).append(ids)
            if row["item"] is not None:
                self.items[key].add(row["item"])
        self.hashes = {size: np.unique(_hashes(np.stack(grams), size)) for size, grams in by_size.items()}

    def hits(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of all occurrences, and the items that occur."""
        ranges: list[tuple[int, int]] = []
        items: set[str] = set()
        ids = np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int32, len(found))
        known = np.concatenate(([0], np.cumsum(ids > 0)))
        for size, hashes in self.hashes.items():
            at = np.flatnonzero(known[size:] - known[:-size] == size) if len(ids) >= size else []
            if len(at) == 0:
                continue
            windows = ids[at[:, None] + np.arange(size)]
            value = _hashes(windows, size)
            place = np.minimum(np.searchsorted(hashes, value), len(hashes) - 1)
            for k in np.flatnonzero(hashes[place] == value):
                if (of := self.items.get(windows[k].tobytes())) is not None:
                    ranges.append((int(at[k]), int(at[k]) + size))
                    items |= of
        return ranges, items


def _hashes(windows: np.ndarray, size: int) -> np.ndarray:
    total = np.zeros(len(windows), np.uint64)
    for k in range(size):
        part = windows[:, k].astype(np.uint64) * _ODD[k % 64]
        total = (total * np.uint64(31)) ^ (part ^ (part >> np.uint64(29)))
    return total


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges without overlap."""
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def gram_blocks(benchmark: DataFrame, n: int, block_grams: int) -> list:
    """The benchmark's windows as broadcast blocks of at most about ``block_grams`` (window, item) pairs."""
    spark = benchmark.sparkSession
    grams = stored(benchmark_grams(benchmark, n))
    count = -(-grams.count() // block_grams)
    if count <= 1:
        return [spark.sparkContext.broadcast(GramSet(grams.collect()))]
    block = F.pmod(F.xxhash64("gram", "item"), F.lit(count))
    return [spark.sparkContext.broadcast(GramSet(grams.where(block == b).collect())) for b in range(count)]


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_grams: int = 250_000) -> DataFrame:
    """``doc_id, text`` with ``n_words``, ``n_hit``, ``n_items``, ``items`` (sorted), ``items_sha256``,
    ``spans`` (code points ``[start, end)`` of the hit words) and ``contaminated``; one row per row of ``docs``."""
    blocks = gram_blocks(benchmark, n, block_grams)
    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, at array<int>, items array<string>, n_words long, "
        "n_hit long, n_items long, items_sha256 string, spans array<struct<start:int,end:int>>, contaminated boolean"
    )
    out = docs.select(docs["doc_id"], docs["text"], F.expr("cast(null as array<int>)").alias("at"), F.expr("cast(null as array<string>)").alias("items"))
    for k, block in enumerate(blocks):
        out = out.select("doc_id", "text", "at", "items").mapInArrow(_scanner(block), schema)
        if k + 1 < len(blocks):
            out = stored(out)  # one block at a time in the executors' memory
    return out.drop("at")


def _scanner(block):
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    kinds = {
        "at": pa.list_(pa.int32()), "items": pa.list_(pa.string()), "n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(),
        "items_sha256": pa.string(), "spans": pa.list_(span), "contaminated": pa.bool_(),
    }

    def mark(batches):
        grams = block.value
        for batch in slices(batches):
            columns = {name: [] for name in kinds}
            for text, at, items in zip(batch["text"].to_pylist(), batch["at"].to_pylist(), batch["items"].to_pylist()):
                found = words(text.encode("utf-8", "replace") if text else None)
                ranges, of = grams.hits(found)
                ranges = merged([*ranges, *(zip(at[::2], at[1::2]) if at else ())])
                items = sorted(of.union(items or ()))
                columns["at"].append([x for pair in ranges for x in pair])
                columns["items"].append(items)
                columns["n_words"].append(len(found))
                columns["n_hit"].append(sum(b - a for a, b in ranges))
                columns["n_items"].append(len(items))
                columns["items_sha256"].append(hashlib.sha256(",".join(items).encode()).hexdigest())
                columns["spans"].append([{"start": a, "end": b} for a, b in spans_of(text, ranges)])
                columns["contaminated"].append(bool(ranges))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text"], *(pa.array(columns[name], kind) for name, kind in kinds.items())], ["doc_id", "text", *kinds]
            )

    return mark


def spans_of(text: str | None, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point ranges of word ranges."""
    if not ranges:
        return []
    raw = text.encode("utf-8", "replace")
    places = [m.span() for m in _RUN.finditer(raw.translate(_FOLD))]
    point = lambda byte: len(raw[:byte].decode("utf-8"))
    return [(point(places[a][0]), point(places[b - 1][1])) for a, b in ranges]


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, block_grams: int = 250_000) -> DataFrame:
    """``docs`` without the words that lie in a benchmark window; documents left without a word are dropped.

    Removal goes on until no window is left, as the words around a removed span become neighbours.
    Documents without hits, also empty ones, keep their rows as they are. An ``n_chars`` column follows
    the text.
    """
    blocks = gram_blocks(benchmark, n, block_grams)
    if len(blocks) == 1:
        return docs.mapInArrow(_remover(blocks[0]), docs.schema)
    out = docs
    while True:  # hits of all blocks are removed together, so the result does not depend on the blocks
        marked = out.select(F.struct(*(out[c] for c in out.columns)).alias("row"), F.expr("cast(null as array<int>)").alias("at"))
        for block in blocks:
            marked = stored(marked.mapInArrow(_range_marker(block), marked.schema))
        if marked.where(F.size("at") > 0).isEmpty():
            return out
        out = stored(marked.mapInArrow(_cut_ranges, docs.schema))


def _range_marker(block):
    def mark(batches):
        grams = block.value
        for batch in slices(batches):
            at = []
            for text, ranges in zip(pa.RecordBatch.from_struct_array(batch["row"])["text"].to_pylist(), batch["at"].to_pylist()):
                found = grams.hits(words(text.encode("utf-8", "replace") if text else None))[0]
                at.append([x for pair in merged([*found, *(zip(ranges[::2], ranges[1::2]) if ranges else ())]) for x in pair])
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(at, pa.list_(pa.int32()))], ["row", "at"])

    return mark


def _cut_ranges(batches):
    for batch in slices(batches):
        rows = pa.RecordBatch.from_struct_array(batch["row"])
        texts, keep = rows["text"].to_pylist(), []
        for k, at in enumerate(batch["at"].to_pylist()):
            if at:
                texts[k] = without(texts[k], spans_of(texts[k], list(zip(at[::2], at[1::2]))))
            keep.append(not at or bool(words(texts[k].encode("utf-8", "replace"))))
        yield replaced(rows, texts).filter(pa.array(keep))


def _remover(block):
    def remove(batches):
        grams = block.value
        for batch in slices(batches):
            texts, keep = batch["text"].to_pylist(), []
            changed = False
            for k, text in enumerate(texts):
                kept = True
                found = words(text.encode("utf-8", "replace") if text else None)
                while found and kept:
                    ranges = merged(grams.hits(found)[0])
                    if not ranges:
                        break
                    changed = True
                    text = without(text, spans_of(text, ranges))
                    found = words(text.encode("utf-8", "replace"))
                    kept = bool(found)
                texts[k] = text
                keep.append(kept)
            if changed:
                batch = replaced(batch, texts)
            yield batch if all(keep) else batch.filter(pa.array(keep))

    return remove


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with the spans taken out; a blank parts what was apart."""
    out, last = [], 0
    for start, end in spans:
        out.append(text[last:start].rstrip(" "))
        last = end
    out.append(text[last:].lstrip(" "))
    return " ".join(x for x in out if x)


def replaced(batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    """``batch`` with other texts, and ``n_chars`` to match where there is such a number."""
    columns = []
    for name, column in zip(batch.schema.names, batch.columns):
        if name == "text":
            column = pa.array(texts, column.type)
        elif name == "n_chars" and pa.types.is_integer(column.type):
            column = pa.array([None if t is None else len(t) for t in texts], column.type)
        columns.append(column)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)
