"""Substring dedup by hashing units of text.

Units are lines. Those of ``_WINDOW`` words or more are cut further, behind each word that has the smallest hash of some
``_WINDOW`` neighbours in its line, so a passage pasted into a line is cut alike everywhere but for fewer than
``_WINDOW`` words at its two ends, which stay. Letters of scripts without blanks count as words.

What is compared is not a piece but the shortest row of neighbouring pieces, from each piece on and up to each piece, that
has ``min_words`` words: nothing goes that does not stand in one earlier place with so many words in a row. The words of a row
are compared in lower case by 128 bits of hash, whatever white space is between them. The earliest row by ``(doc_id, text
hash, position)`` stays; of the others the pieces go.

Three shuffles: rows of pieces by digest, removed ranges by document, and texts to their ranges. A task keeps the
earliest of equal rows among some 500,000 and knows the others to be later ones, so a very frequent passage
crosses the shuffle once for each of those, not once for each document.

Defined results: a null or empty text, or one without words, stays as it is; equal rows (same ``doc_id`` and text) are
one document and get the same result; a null ``doc_id`` ranks last; rows with equal ``doc_id`` and other text are
ranked by text hash; an empty table gives no rows; other columns are ignored (kept by ``remove_repeats``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrante.llm.common import slices
from quadrante.llm.decontaminate import replaced

#: Of so many words in a row, one is chosen to cut behind.
_WINDOW = 15
#: Words that a repeat must have in a row: at least so many of 50 are left without the two ends.
MIN_WORDS = 50 - 2 * _WINDOW
#: Words, and letters of scripts that set no blanks between words (Thai to Khmer, kana, ideographs).
_WORD = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]|"
                   r"[^\s\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]+")  # fmt: skip
_BREAK = re.compile("\n")
#: Rows of pieces that a task compares among themselves before they are shuffled, and words that it cuts at a time.
_COMBINED, _CUT_WORDS = 500_000, 200_000
#: Odd multipliers of the two halves of a digest, and their inverses modulo 2**64.
_FACTORS = [0x9E3779B97F4A7C13, 0xC2B2AE3D27D4EB4F]
_INVERSES = [pow(f, -1, 1 << 64) for f in _FACTORS]


class _Hashes(dict):
    """64 bits of the MD5 of each word in lower case; remembers a bounded number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        found = self[word] = int.from_bytes(hashlib.md5(word.lower().encode("utf-8", "replace")).digest()[:8], "big")
        return found


def _chosen(hashes: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Words that start a piece: the first of each unit and those behind the smallest hash (the last of equal ones) of a window."""
    n = len(hashes)
    starts = np.ones(n, bool)
    starts[1:] = unit[1:] != unit[:-1]
    at = np.flatnonzero(unit[: n - _WINDOW + 1] == unit[_WINDOW - 1 :]) if n >= _WINDOW else np.zeros(0, np.int64)
    least, best = hashes[at], at
    for k in range(1, _WINDOW):
        other = hashes[at + k]
        take = other <= least
        least, best = np.where(take, other, least), np.where(take, at + k, best)
    behind = best + 1
    starts[behind[behind < n]] = True
    return np.flatnonzero(starts)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rows_of_pieces(texts: list[str], min_words: int, memory: dict | None = None) -> tuple[np.ndarray, ...]:
    """``(text, start, end, d1, d2)``: of each text in turn, the code points and digests of its rows of pieces by start."""
    memory = _Hashes() if memory is None else memory
    places, words, units, ends, n_units = [], [], [], [], 0
    for text in texts:
        found = list(_WORD.finditer(text))
        start = np.fromiter(map(re.Match.start, found), np.int64, len(found))
        words.append(np.fromiter(map(memory.__getitem__, map(re.Match.group, found)), np.uint64, len(found)))
        cuts = np.fromiter((m.end() for m in _BREAK.finditer(text)), np.int64)
        units.append(np.searchsorted(cuts, start, "right") + n_units)
        n_units += len(cuts) + 1
        if len(start):
            start[0] = 0
        places.append(start)
        ends.append(len(text))
    sizes = np.array([len(p) for p in places], np.int64)
    hashes, place = np.concatenate(words), np.concatenate(places)
    n = len(hashes)
    if n == 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.int64, np.int64))
    piece = _chosen(hashes, np.concatenate(units))  # word each piece starts with
    behind = np.append(piece[1:], n)
    border = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.searchsorted(border, piece, "right") - 1
    # From each piece on, and up to each piece.
    last = np.searchsorted(behind, piece + min_words, "left")
    a1 = np.flatnonzero(piece + min_words <= border[owner + 1])
    b2 = np.flatnonzero(behind - min_words >= border[owner])
    first = np.searchsorted(piece, behind[b2] - min_words, "right") - 1
    pairs = np.unique(np.concatenate([a1 * (len(piece) + 1) + last[a1], first * (len(piece) + 1) + b2]))
    a, b = np.divmod(pairs, len(piece) + 1)
    i, j = piece[a], behind[b]
    digests = []
    for factor, inverse in zip(_FACTORS, _INVERSES):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(hashes ^ np.uint64(factor)) * _powers(factor, n - 1), dtype=np.uint64)))
        digests.append(_mixed((sums[j] - sums[i]) * _powers(inverse, n)[i] + (j - i).astype(np.uint64)).view(np.int64))
    text = owner[a]
    end = np.where(j == border[text + 1], np.array(ends, np.int64)[text], place[np.minimum(j, n - 1)])
    return text, place[i].astype(np.int32), end.astype(np.int32), digests[0], digests[1]


_SCHEMA = "doc_id long, rank long, start int, end int, sure boolean, d1 long, d2 long"


def _digests(min_words: int):
    """Rows of pieces of each document; of equal ones in a task's share all but the first are ``sure`` to go, and have
    their own numbers in place of the digest, which no longer matters."""

    def combined(ids, ranks, parts) -> pa.RecordBatch:
        owner, start, end, d1, d2 = (np.concatenate(x) for x in zip(*parts))
        nameless = np.array([i is None for i in ids])
        named = np.array([i or 0 for i in ids], np.int64)
        ranks = np.array(ranks, np.int64)
        by = np.lexsort((ranks, named, nameless))
        new = np.zeros(len(by), np.int64)
        new[1:] = (ranks[by][1:] != ranks[by][:-1]) | (named[by][1:] != named[by][:-1]) | (nameless[by][1:] != nameless[by][:-1])
        order = np.empty(len(by), np.int64)
        order[by] = np.cumsum(new)  # equal rows have equal places
        by = np.lexsort((start, order[owner], d2, d1))
        owner, start, end, d1, d2 = (x[by] for x in (owner, start, end, d1, d2))
        sure, own = np.zeros(len(by), bool), np.zeros(len(by), bool)
        sure[1:] = (d1[1:] == d1[:-1]) & (d2[1:] == d2[:-1])
        own[1:] = sure[1:] & (order[owner][1:] == order[owner][:-1]) & (start[1:] == start[:-1])
        keep = ~own
        place = _mixed(named[owner].view(np.uint64) + np.uint64(1)) ^ _mixed(start.astype(np.uint64))
        d1, d2 = np.where(sure, ranks[owner] ^ place.view(np.int64), d1), np.where(sure, end.astype(np.int64), d2)
        names = pa.array(named[owner], mask=nameless[owner])
        arrays = [names, *map(pa.array, (ranks[owner], start, end, sure, d1, d2))]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "rank", "start", "end", "sure", "d1", "d2"]).filter(pa.array(keep))

    def run(batches):
        memory = _Hashes()
        ids, ranks, parts, held = [], [], [], 0
        waiting, size = [], 0

        def cut():
            nonlocal waiting, size, held
            text, *rest = rows_of_pieces(waiting, min_words, memory)
            parts.append((text + (len(ids) - len(waiting)), *rest))
            held += len(text)
            waiting, size = [], 0

        for batch in slices(batches):
            for doc_id, rank, text in zip(*(batch[n].to_pylist() for n in ("doc_id", "rank", "text"))):
                ids.append(doc_id)
                ranks.append(rank)
                waiting.append(text)
                size += len(text)
                if size >= 5 * _CUT_WORDS:
                    cut()
                    if held >= _COMBINED:
                        yield combined(ids, ranks, parts)
                        ids, ranks, parts, held = [], [], [], 0
        if waiting:
            cut()
        if parts:
            yield combined(ids, ranks, parts)

    return run


def _ranking(docs: DataFrame) -> Callable[[str], Column]:
    """Hash of a text, which tells rows with one ``doc_id`` apart; 0 where no id repeats, as eight random bytes a row are a
    fourth of the shuffle. The order of documents is the same either way."""
    same = docs.groupBy(docs["doc_id"].cast("long")).count().where("count > 1")
    return (lambda text: F.lit(0).cast("long")) if same.isEmpty() else F.xxhash64


def repeated_ranges(docs: DataFrame, rank: Column, min_words: int = 8) -> DataFrame:
    """``(doc_id, rank, ranges)``, ``rank`` made of ``text``: code-point ranges of each document that stand earlier; documents without are left out."""
    texts = docs.where(docs["text"] != "").select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    texts = texts.select("doc_id", rank.alias("rank"), "text")
    rows = texts.mapInArrow(_digests(min_words), _SCHEMA)
    # Null ids last: structs compare field by field.
    rows = rows.withColumn("place", F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "rank", "start")).drop("doc_id", "rank", "start")
    earliest = F.first("place").over(Window.partitionBy("sure", "d1", "d2").orderBy("place"))
    later = rows.withColumn("earliest", earliest).where(F.col("sure") | (F.col("place") != F.col("earliest")))
    span = F.struct("place.start", "end")
    return later.groupBy("place.doc_id", "place.rank").agg(F.collect_set(span).alias("ranges"))


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """The ranges in order, those that touch put together."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return "".join([*kept, text[at:]])


def _with_repeats(docs: DataFrame, min_words: int) -> DataFrame:
    """``docs`` as a struct ``row`` next to the repeated ranges of its text."""
    rank = _ranking(docs)
    repeats = repeated_ranges(docs, rank("text"), min_words).select(F.col("doc_id").alias("id"), "rank", "ranges")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (rank("row.text") == F.col("rank"))
    return rows.join(repeats, same, "left").select("row", "ranges")


def substring_spans(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """``doc_id, text, n_removed, removed``: the kept text of each row, and ``removed`` code-point ranges ``[start, end)`` of
    the original text with their length in all."""

    def run(batches):
        for batch in slices(batches):
            texts, counts, removed = [], [], []
            for text, ranges in zip(*(batch[n].to_pylist() for n in ("text", "ranges"))):
                spans = merged(ranges or [])
                texts.append(without(text, spans) if spans else text)
                counts.append(sum(b - a for a, b in spans))
                removed.append([{"start": a, "end": b} for a, b in spans])
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            arrays = [batch["doc_id"], pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, span)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text", "n_removed", "removed"])

    rows = _with_repeats(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")), min_words)
    return rows.select("row.doc_id", "row.text", "ranges").mapInArrow(run, "doc_id long, text string, n_removed long, removed array<struct<start:int,end:int>>")


def remove_repeats(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """``docs``, all columns, with the kept texts; a document that loses its last word is dropped."""

    def run(batches):
        for batch in slices(batches):
            rows = pa.RecordBatch.from_struct_array(batch["row"])
            texts, keep = rows["text"].to_pylist(), []
            for k, ranges in enumerate(batch["ranges"].to_pylist()):
                if ranges:
                    texts[k] = without(texts[k], merged(ranges))
                keep.append(not ranges or bool(texts[k].strip()))
            yield replaced(rows, texts).filter(pa.array(keep))

    return _with_repeats(docs, min_words).mapInArrow(run, docs.schema)
