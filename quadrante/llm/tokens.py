"""Tokenizing documents with a tokenizer file of the ``tokenizers`` library, each distinct word once per worker.

Both supported kinds of file split a text at every blank before a word, whatever stands around it. So
the pieces between blanks are encoded on their own and remembered, as natural text repeats its words;
the library does all encoding. Texts in which a blank stands before white space or at the end are
given to the library whole. Arrow cuts the texts of a slice, numbers the distinct pieces and puts their ids together; Python
sees each distinct piece of a slice once.
"""

from __future__ import annotations

import gc
import json
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrante.llm.common import stored

_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = r"!-&(-/:-@\[-`{-~"  # ASCII marks but the apostrophe, with which contractions begin
_PLAIN = re.compile(rf"(?:[{_LATIN}]++|[{_MARKS}]++|\n(?=[{_LATIN}{_MARKS}]))+\Z")
#: A mark behind a letter and before a blank or the end, and a lone line break between letters or marks, are words of their own to both kinds.
_MARK = rf"([{_LATIN}])([.,;:!?])([ \n]|\z)"
_BREAK = rf"([{_LATIN}{_MARKS}])\n([{_LATIN}{_MARKS}])"
_PARTS = re.compile(rf"[{_LATIN}]+|[{_MARKS}]+|\n")
#: Words that a worker remembers at most; more take more memory and less time.
WORDS = 1_200_000
_ALONE = "\x00"  # begins the key of what has no blank before it
_BETWEEN = "|"  # stands between words that are encoded together
_LINE = 1000
_workers: dict[tuple, "WordTokenizer"] = {}


def sized(batches, size: int = 8 << 20, rows: int = 2500):
    """Arrow batches cut into pieces of about ``size`` bytes of ``text`` and so many rows at most; a longer text is a piece of its own."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.binary_length(batch["text"]).fill_null(0)), dtype=np.int64)
        k = 0
        while k < batch.num_rows:
            before = ends[k - 1] if k else 0
            end = min(k + rows, max(k + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(k, end - k)
            k = end


def _marked(texts: pa.Array) -> pa.Array:
    """The texts with blanks before all their words, and what begins a word without one marked by ``_ALONE``."""
    texts = pc.replace_substring_regex(texts, _MARK, f"\\1 {_ALONE}\\2\\3")
    # A letter between two breaks is taken by the first; the second is met in another turn.
    while pc.any(pc.match_substring_regex(texts, _BREAK)).as_py():
        texts = pc.replace_substring_regex(texts, _BREAK, f"\\1 {_ALONE}\n {_ALONE}\\2")
    first = pa.scalar(_ALONE, pa.large_string())
    return pc.binary_join_element_wise(first, texts, pa.scalar("", pa.large_string()))


class WordTokenizer:
    """Encodes texts to little-endian ids of ``width`` bytes, with a memory of at most about ``limit`` words. It has two
    generations: when the younger is half of that, it becomes the older, whose words come back if they are met again.

    A key of the memory stands for itself with a blank before it, or without one if it begins with ``_ALONE``.
    """

    def __init__(self, path: str, limit: int = WORDS) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        kinds = json.dumps(described["pre_tokenizer"])
        self.lower = '"Lowercase"' in json.dumps(described["normalizer"])  # such a file also drops white space
        self.splits = "ByteLevel" in kinds and '"add_prefix_space": true' not in kinds
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.type = f"<u{self.width}"
        self.special = [token["content"] for token in described["added_tokens"]]
        self.between = self.library.encode(_BETWEEN, add_special_tokens=False).ids[0] if self.lower else None
        self.limit = limit
        self.of: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        if isinstance(texts, list):
            texts = pa.array(texts, pa.large_string())
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the memory of words is costly to walk
        try:
            return self._encode(texts.cast(pa.large_string()).fill_null(""))
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: pa.Array) -> list[bytes]:
        whole = self._uncut(texts)
        lists = pc.split_pattern(_marked(texts.filter(pa.array(~whole))), " ")
        # Each distinct piece of these texts is looked up once; Arrow puts the ids of all pieces behind each other.
        flat = lists.flatten().dictionary_encode()
        pieces = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = list(map(self.of.get, pieces))
        missing = [k for k, v in enumerate(values) if v is None]
        # A blank before white space (or at the end) is no cut: such texts go to the library whole.
        odd = [k for k in missing if not pieces[k] or pieces[k][0].isspace()]
        for k in odd:
            values[k] = b""
        missing = [k for k in missing if values[k] is None]
        learnt = self._learn([pieces[k] for k in missing])
        for k in missing:
            piece = pieces[k]
            values[k] = learnt[piece] if piece in learnt else self.of[piece]
        ids = pa.array(values, pa.large_binary()).take(flat.indices)
        at = np.asarray(lists.offsets)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1)[at].tolist() if len(ids) else [0] * len(at)
        data = memoryview(ids.buffers()[2] or b"")
        if odd:
            is_odd = np.zeros(len(pieces), bool)
            is_odd[odd] = True
            held = np.diff(np.concatenate(([0], np.cumsum(is_odd[np.asarray(flat.indices)])))[at])
            whole[np.flatnonzero(~whole)[held > 0]] = True
            cut = iter([bytes(data[x:y]) for x, y, n in zip(ends, ends[1:], held.tolist()) if not n])
        else:
            cut = iter([bytes(data[x:y]) for x, y in zip(ends, ends[1:])])
        rest = iter(self._library(texts.filter(pa.array(whole)).to_pylist()))
        return [next(rest if w else cut) for w in whole.tolist()]

    def _uncut(self, texts: pa.Array) -> np.ndarray:
        """Which texts must go to the library whole, before their pieces are seen."""
        if not self.splits:
            return np.ones(len(texts), bool)
        out = np.asarray(pc.equal(pc.binary_length(texts), 0)).copy()
        for held in (_ALONE, *self.special):
            out |= np.asarray(pc.match_substring(texts, held))
        return out

    def _keys(self, piece: str) -> list[str]:
        """Keys whose ids, one after the other, are those of the piece."""
        lead, word = (_ALONE, piece[1:]) if piece[0] == _ALONE else ("", piece)
        if self.lower:
            lead = ""
            if word.isascii():
                word = word.lower()
        if word.isalpha():
            return [lead + word]
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return [lead + word[:-1], _ALONE + word[-1]]
        if _PLAIN.match(word):
            parts = _PARTS.findall(word.lower() if self.lower else word)
            return [lead + parts[0], *(_ALONE + p for p in parts[1:])]
        return [lead + word]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Remembers the ids of new pieces if these are words, with a mark or without; returns those of the others."""
        if len(self.of) > self.limit // 2:
            self.older, self.of = self.of, {}
        of, older = self.of, self.older
        if older:
            known = {piece: older[piece] for piece in pieces if piece in older}
            of.update(known)
            pieces = [piece for piece in pieces if piece not in known]
        words = [piece for piece in pieces if piece.isalpha()]
        keys = [w.lower() if w.isascii() else w for w in words] if self.lower else words
        other = {piece: self._keys(piece) for piece in pieces if not piece.isalpha()}
        wanted = dict.fromkeys(keys)
        wanted.update((k, None) for own in other.values() for k in own)
        new = [k for k in wanted if k not in of]
        if older:
            known = {k: older[k] for k in new if k in older}
            of.update(known)
            new = [k for k in new if k not in known]
        if self.lower:
            together = [k for k in new if k.isalpha()]
            of.update(zip(together, self._together(together)))
            new = [k for k in new if k not in of]
        of.update(zip(new, self._library([k[1:] if k[:1] == _ALONE else " " + k for k in new])))
        if self.lower:
            of.update(zip(words, [of[k] for k in keys]))
        learnt = {}
        for piece, own in other.items():
            ids = of[own[0]] if len(own) == 1 else b"".join([of[k] for k in own])
            if len(own) <= 2:
                of[piece] = ids
            else:
                learnt[piece] = ids
        return learnt

    def _together(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, which the library gets in lines of many with a mark between, as its steps for each text cost
        more than a word. To such a file a mark is a word of its own and white space is nothing."""
        out: list[bytes] = []
        for k in range(0, len(words), _LINE):
            part = words[k : k + _LINE]
            ids = np.frombuffer(b"".join(self._library([f" {_BETWEEN}".join(part)])), self.type)
            at = np.flatnonzero(ids == self.between)
            if len(at) != len(part) - 1:
                return self._library(words)
            data = ids.tobytes()
            ends = [*(at * self.width).tolist(), len(data)]
            starts = [0, *((at + 1) * self.width).tolist()]
            out += [data[x:y] for x, y in zip(starts, ends)]
        return out

    def _library(self, texts: list[str]) -> list[bytes]:
        encoded = self.library.encode_batch_fast(texts, add_special_tokens=False) if texts else []
        kind = "H" if self.width == 2 else "I"
        if sys.byteorder == "little":
            return [array(kind, e.ids).tobytes() for e in encoded]
        return [np.array(e.ids, self.type).tobytes() for e in encoded]


def worker_tokenizer(path: str, limit: int) -> WordTokenizer:
    """The tokenizer of this Python worker, kept between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, limit) not in _workers:
        _workers[path, limit] = WordTokenizer(path, limit)
    return _workers[path, limit]


def tokenized(docs: DataFrame, path: str, end_id: int, extra=None, extra_schema: str = "", words: int = WORDS) -> DataFrame:
    """``(seq, doc_id, n, ids)`` for each row of ``docs``, stored: ``ids`` are little-endian ids of two bytes, or
    of four where the vocabulary needs them, with ``end_id`` last; ``seq`` numbers the rows and tells
    equal ones apart. ``extra`` maps the arrays of a batch to more columns. ``words`` bounds the memory of a worker,
    about 200 bytes each. A null text is empty."""

    def encode(batches):
        tokenizer = worker_tokenizer(path, words)
        end = np.array([end_id], tokenizer.type).tobytes()
        for part in sized(batches):
            ids = [x + end for x in tokenizer.encode(part["text"])]
            n = pa.array([len(x) // tokenizer.width for x in ids], pa.int64())
            more = extra([np.frombuffer(x, tokenizer.type) for x in ids]) if extra else []
            names = ["seq", "doc_id", "n", "ids", *(f"x{i}" for i in range(len(more)))]
            yield pa.RecordBatch.from_arrays([part["seq"], part["doc_id"], n, pa.array(ids, pa.binary()), *more], names)

    rows = docs.select(F.monotonically_increasing_id().alias("seq"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return stored(rows.mapInArrow(encode, f"seq long, doc_id long, n long, ids binary{extra_schema}"))


def crc_of_ids(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
