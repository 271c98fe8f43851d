"""Binary token output: frequency-ranked ids in byte-aligned codes with separate control bytes.

Ids are replaced by their rank in the whole corpus (most frequent first; ties by id), so that most need one
byte. A rank takes as many bytes as it needs, one to four; its length less one stands in two bits of a
control byte, apart from the data, four ranks to a byte. A reader therefore learns the lengths of four
ranks by one look-up in a table of 256 rows and decodes a whole block with array operations.

A folder holds ``ranks/`` (the id of each rank, four bytes each) and ``blocks/``, whose files follow each
other in the order of their names' numbers, as do the blocks in a file. A block, all numbers
little-endian::

    b"QTB1" | documents u4 | ids u4 | data bytes u4
    doc_id i8 each | doc_id is null u1 each | ids u4 each | control bytes | data bytes | 0x0A

Blocks hold whole documents and are closed at 65,536 ids, files at 128 blocks; a longer document is a
block of its own. The files are written and read by Spark's text and binary sources, so any store will do.

Memory: a task holds a few files' worth of rows. A hot ``doc_id`` is spread, as rows are range-partitioned
by ``(doc_id, seq)``. The id counts and the rank table are bounded by the vocabulary.

Defined results: a null text is an empty one, of which only the end id is written; a null ``doc_id``
comes first; rows of equal ``doc_id`` keep the order of the table; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrante.llm.common import shared_dir, stored
from quadrante.llm.tokens import crc_of_ids, tokenized

MAGIC = b"QTB1"
BLOCK_IDS = 1 << 16
FILE_BLOCKS = 128
_LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_MASKS = np.array([0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


class TokenFiles(NamedTuple):
    path: str


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes."""
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = lengths - 1
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    as_bytes = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.astype(np.uint8).tobytes(), as_bytes[np.arange(4) < lengths[:, None]].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks; lengths come from the table, bytes from one gather over shifted views."""
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    ends = np.cumsum(lengths)
    raw = np.frombuffer(data + b"\0\0\0", np.uint8)
    words = np.lib.stride_tricks.as_strided(raw, (len(raw) - 3, 4), (1, 1)) if n else np.zeros((0, 4), np.uint8)
    gathered = np.ascontiguousarray(words[ends - lengths]).view("<u4").reshape(-1)
    return gathered & _MASKS[lengths - 1]


def _block(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    ranks = np.concatenate([r for _, r in docs])
    control, data = encode_ranks(ranks)
    head = MAGIC + np.array([len(docs), len(ranks), len(data)], "<u4").tobytes()
    ids = np.array([0 if d is None else d for d, _ in docs], "<i8").tobytes() + np.array([d is None for d, _ in docs], "u1").tobytes()
    return head + ids + np.array([len(r) for _, r in docs], "<u4").tobytes() + control + data


def decode_file(content: bytes, id_of_rank: np.ndarray):
    """Yields ``(doc_id, ids)`` of a file's documents in their order."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        docs, n, size = (int(x) for x in np.frombuffer(content, "<u4", 3, at + 4))
        at += 16
        doc_ids = np.frombuffer(content, "<i8", docs, at)
        nulls = np.frombuffer(content, "u1", docs, at + 8 * docs)
        lengths = np.frombuffer(content, "<u4", docs, at + 9 * docs)
        at += 13 * docs
        controls = -(-n // 4)
        ids = id_of_rank[decode_ranks(content[at : at + controls], content[at + controls : at + controls + size], n)]
        at += controls + size
        if content[at : at + 1] != b"\n":
            raise ValueError(f"block not closed at byte {at}")
        at += 1
        start = 0
        for doc_id, null, length in zip(doc_ids.tolist(), nulls.tolist(), lengths.tolist()):
            yield None if null else doc_id, ids[start : start + length]
            start += length


def id_counts(tokens: DataFrame, width: int) -> DataFrame:
    """``(id, count)`` over all documents, summed in each task first."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                ids = b"".join(x.as_buffer() for x in batch["ids"].slice(k, 1000))
                own = np.bincount(np.frombuffer(ids, f"<u{width}"))
                if len(own) > len(total):
                    own[: len(total)] += total
                    total = own
                else:
                    total[: len(own)] += own
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], ["id", "count"])

    return tokens.select("ids").mapInArrow(count, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int, path: str) -> TokenFiles:
    """Tokenizes all documents and writes the files below ``path``, in ascending order of ``doc_id``."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    width = 2 if vocabulary <= 1 << 16 else 4
    tokens = tokenized(docs, tokenizer_path, end_id)
    counts = np.zeros(vocabulary, np.int64)
    for row in id_counts(tokens, width).collect():  # at most one row for each id of the vocabulary
        counts[row["id"]] = row["count"]
    ids = np.lexsort((np.arange(vocabulary), -counts)).astype(np.uint32)
    rank_of_id = np.empty(vocabulary, np.uint32)
    rank_of_id[ids] = np.arange(vocabulary, dtype=np.uint32)
    ranks = spark.sparkContext.broadcast(rank_of_id)

    def pack(batches):
        of, open_docs, size = ranks.value, [], 0
        for batch in batches:
            blocks = []
            for doc_id, raw in zip(batch["doc_id"].to_pylist(), batch["ids"]):
                own = of[np.frombuffer(raw.as_buffer(), f"<u{width}")]
                if open_docs and size + len(own) > BLOCK_IDS:
                    blocks.append(_block(open_docs))
                    open_docs, size = [], 0
                open_docs.append((doc_id, own))
                size += len(own)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.binary())], ["value"])
        if open_docs:
            yield pa.RecordBatch.from_arrays([pa.array([_block(open_docs)], pa.binary())], ["value"])

    ordered = tokens.repartitionByRange("doc_id", "seq").sortWithinPartitions("doc_id", "seq").select("doc_id", "ids")
    blocks = ordered.mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
    blocks.write.option("maxRecordsPerFile", FILE_BLOCKS).text(f"{path}/blocks")
    table = spark.createDataFrame([(bytearray(ids.astype("<u4").tobytes()),)], "value binary")
    table.select(F.col("value").cast("string")).coalesce(1).write.text(f"{path}/ranks")
    return TokenFiles(path)


def read_tokens(spark: SparkSession, files: TokenFiles, digest: bool = False) -> DataFrame:
    """``(doc_id, start, n_tokens)`` of every document in the files' order, with its ``ids`` (array of int), or
    with ``digest`` their CRC-32 as ``ids_crc32``. ``start`` counts the ids of all documents before it."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{files.path}/ranks").select("content").first()
    id_of_rank = spark.sparkContext.broadcast(np.frombuffer(bytes(raw["content"])[:-1], "<u4"))
    payload, kind = ("ids_crc32 long", pa.int64()) if digest else ("ids array<int>", pa.list_(pa.int32()))

    def decode(batches):
        for batch in batches:
            for part, split, content in zip(batch["part"].to_pylist(), batch["split"].to_pylist(), batch["content"].to_pylist()):
                at, rows = 0, []
                for doc_id, ids in decode_file(content, id_of_rank.value):
                    rows.append((doc_id, at, len(ids), crc_of_ids(ids) if digest else ids.astype(np.int32)))
                    at += len(ids)
                    if len(rows) == 2000:
                        yield out(part, split, rows)
                        rows = []
                if rows:
                    yield out(part, split, rows)

    def out(part, split, rows):
        doc_ids, starts, sizes, payloads = zip(*rows)
        arrays = [pa.array([part] * len(rows), pa.int64()), pa.array([split] * len(rows), pa.int64())]
        arrays += [pa.array(x, pa.int64()) for x in (doc_ids, starts, sizes)] + [pa.array(payloads, kind)]
        return pa.RecordBatch.from_arrays(arrays, ["part", "split", "doc_id", "at", "n_tokens", payload.split()[0]])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{files.path}/blocks")
    number = lambda pattern: F.regexp_extract("path", pattern, 1).cast("long")
    found = found.select(number(r"/part-(\d+)-[^/]*$").alias("part"), number(r"-c(\d+)[^/]*$").alias("split"), "content")
    docs = stored(found.mapInArrow(decode, f"part long, split long, doc_id long, at long, n_tokens long, {payload}"))
    # One row for each file: what comes before it.
    totals = docs.groupBy("part", "split").agg(F.sum("n_tokens").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.orderBy("part", "split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("part", "split", before.alias("base"))
    joined = docs.join(bases, ["part", "split"])
    return joined.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", payload.split()[0])


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes the files to the shared folder and reads them back: ``doc_id, start, n_tokens, ids_crc32``."""
    spark = docs.sparkSession
    return read_tokens(spark, write_tokens(docs, tokenizer_path, end_id, shared_dir(spark)), digest=True)
