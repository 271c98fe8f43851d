"""Alignment of two tokenizers over the same texts, by merge-path partitioning.

The tokens of A and B of one text are two rising lists of byte ends. Where an end is in both, a group of tokens
closes and its last A and B tokens are linked. The merging of the two lists is cut at diagonals, ``size`` merged ends apart; a
binary search on each finds how many ends of A and of B lie before it. So every piece is the same amount of
work whatever the lists look like, and a long text is dealt over tasks. Pieces find the common ends within
their range (equal ends are never parted), and what hangs over at their borders is stitched in the order of the pieces.

Counts of linked pairs cover all texts. Of two tokens that end together, one is a suffix of the other, so a pair is known
by the longer token and the length of the shorter: the pairs number at most the bytes of both vocabularies
(times the ids of equal bytes, such as a byte and its fallback token), whatever the corpus. That many
counters are kept in a task, collected, and broadcast.

Nulls and odd rows: a text that is null, empty, or that one of the tokenizers changes (its tokens' bytes are not those of a
blank and the text) has no tokens; each row counts, whatever its id; no rows, no result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrante.llm.common import slices, stored

#: Merged ends of a piece.
SIZE = 1 << 14
# Fixed value: where byte-level tokenizers part a text.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LONG_RUN = re.compile(r"\S{2000}|\s{2000}")
_workers: dict[tuple, "Pair"] = {}


def byte_alphabet() -> dict[str, int]:
    """Characters of byte-level vocabularies and their bytes: printable ones stand for themselves, others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def _twins(tokens: list[bytes]) -> tuple[np.ndarray, int]:
    """Number of each token among those of equal bytes, and the most of these."""
    seen: dict[bytes, int] = {}
    numbers = []
    for token in tokens:
        numbers.append(seen.get(token, 0))
        seen[token] = numbers[-1] + 1
    return np.array(numbers, np.int64), max(seen.values(), default=1)


class Vocabularies:
    """The bytes of the tokens of both tokenizers, and a number for each pair of tokens that can end together."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        with open(path_a, encoding="utf-8") as file:
            described = json.load(file)
        letters = byte_alphabet()
        entries = {**described["model"]["vocab"], **{t["content"]: t["id"] for t in described["added_tokens"]}}
        self.a = [b""] * (max(entries.values()) + 1)
        for token, k in entries.items():
            known = all(c in letters for c in token)
            self.a[k] = bytes(letters[c] for c in token) if known else token.encode()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b = []
        for k in range(self.pieces.vocab_size()):
            piece = self.pieces.id_to_piece(k)
            self.b.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(k) else piece.replace("▁", " ").encode())
        self.length_a, self.length_b = (np.array([len(t) for t in x], np.int64) for x in (self.a, self.b))
        self.twin_a, most_a = _twins(self.a)
        self.twin_b, most_b = _twins(self.b)
        self.most_a, self.most_b = most_a, most_b
        slots = np.concatenate([(self.length_a + 1) * most_b, (self.length_b + 1) * most_a])
        first = np.cumsum(slots) - slots
        self.first_a, self.first_b = first[: len(self.a)], first[len(self.a) :]
        self.codes = int(slots.sum())

    def code(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number below ``codes`` of pairs of which one token's bytes end with those of the other."""
        la, lb = self.length_a[a], self.length_b[b]
        return np.where(lb <= la, self.first_a[a] + lb * self.most_b + self.twin_b[b], self.first_b[b] + la * self.most_a + self.twin_a[a])


class Pair(Vocabularies):
    """Both tokenizers, in a worker."""

    def __init__(self, path_a: str, path_b: str) -> None:
        super().__init__(path_a, path_b)
        self.encode_a = self._merging(path_a)
        self.bytes = [np.frombuffer(b"".join(x), np.uint8) for x in (self.a, self.b)]

    def _merging(self, path: str):
        """Encodes texts as the file says. Where its merges come in the order of the ids they make, as in common byte-level files, the
        ids are ranks and ``tiktoken`` gives the same ids in a third of the time."""
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model, split = described["model"], described["pre_tokenizer"] or {}
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
        made = [model["vocab"].get(m.replace(" ", "", 1), -1) for m in merges]
        special = {t["id"] for t in described["added_tokens"]}
        ranked = made == sorted(set(made)) and min(made, default=0) == 256 and all(len(t) == 1 for t in self.a[:256])
        ordinary = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True  # their strings in a text are plain text
        whole = lambda text: library.encode(text, add_special_tokens=False).ids
        if ranked and ordinary and not described["normalizer"] and not any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            import tiktoken

            ranks = {token: k for k, token in enumerate(self.a) if k not in special}
            quick = tiktoken.Encoding("a", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            return lambda text: whole(text) if _LONG_RUN.search(text) else quick(text)  # the former's time does not grow with a word's square
        return whole

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of each text; none where their bytes are not a blank and the text."""
        wanted = [(" " + t).encode("utf-8", "replace") if t else b"" for t in texts]
        sides = []
        for found, lengths, table in (
            ([self.encode_a(" " + t) if t else [] for t in texts], self.length_a, self.bytes[0]),
            (self.pieces.encode(texts, num_threads=1), self.length_b, self.bytes[1]),
        ):
            ids = [np.array(x, "<u2" if len(lengths) <= 1 << 16 else "<u4") for x in found]
            starts = np.cumsum(lengths) - lengths
            sides.append([x if self._same(x, w, lengths, starts, table) else None for x, w in zip(ids, wanted)])
        none = np.zeros(0, np.uint16)
        return [(none, none) if a is None or b is None else (a, b) for a, b in zip(*sides)]

    @staticmethod
    def _same(ids: np.ndarray, wanted: bytes, lengths: np.ndarray, starts: np.ndarray, table: np.ndarray) -> bool:
        sizes = lengths[ids]
        reach = np.cumsum(sizes)
        if (int(reach[-1]) if len(ids) else 0) != len(wanted):
            return False
        first = starts[ids]
        at = np.arange(len(wanted)) + np.repeat(first - (reach - sizes), sizes)
        return table[at].tobytes() == wanted


def _worker(kind, *args):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (kind, *args) not in _workers:
        _workers[(kind, *args)] = kind(*args)
    return _workers[(kind, *args)]


def merge_cuts(a: np.ndarray, b: np.ndarray, size: int) -> list[tuple[int, int]]:
    """How many of ``a`` and ``b`` lie before each diagonal of their merging, from (0, 0) to the ends. An end of ``a`` goes before
    its equal of ``b``, which is then taken in too."""
    cuts = [(0, 0)]
    for d in range(size, len(a) + len(b), size):
        low, high = max(0, d - len(b)), min(d, len(a))
        while low < high:
            middle = (low + high) // 2
            if a[middle] <= b[d - 1 - middle]:
                low = middle + 1
            else:
                high = middle
        i, j = low, d - low
        if 0 < i and j < len(b) and a[i - 1] == b[j]:
            j += 1
        cuts.append((i, j))
    return [*cuts, (len(a), len(b))]


def token_pieces(docs: DataFrame, path_a: str, path_b: str, size: int = SIZE) -> DataFrame:
    """``row, doc_id, piece, pieces, start_a, start_b, a, b``, stored: the ids of each piece and the bytes before them."""

    def run(batches):
        pair = _worker(Pair, path_a, path_b)
        for part in slices(batches, 128):
            texts = [t or "" for t in part["text"].to_pylist()]
            rows = []
            for row, doc_id, (a, b) in zip(part["row"].to_pylist(), part["doc_id"].to_pylist(), pair.encode(texts)):
                if len(a) + len(b) <= size:
                    rows.append((row, doc_id, 0, 1, 0, 0, a.tobytes(), b.tobytes()))
                    continue
                ends = [np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b])]
                cuts = merge_cuts(*ends, size)
                for k, ((i, j), (m, n)) in enumerate(zip(cuts, cuts[1:])):
                    before = [int(e[x - 1]) if x else 0 for e, x in zip(ends, (i, j))]
                    rows.append((row, doc_id, k, len(cuts) - 1, *before, a[i:m].tobytes(), b[j:n].tobytes()))
            kinds = [pa.int64()] * 2 + [pa.int32()] * 2 + [pa.int64()] * 2 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    names = ["row", "doc_id", "piece", "pieces", "start_a", "start_b", "a", "b"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return stored(rows.mapInArrow(run, "row long, doc_id long, piece int, pieces int, start_a long, start_b long, a binary, b binary"))


class Merged:
    """The tokens of a batch of pieces, one after the other, and which of them end together."""

    def __init__(self, batch: pa.RecordBatch, vocabularies: Vocabularies) -> None:
        kinds = ["<u2" if len(x) <= 1 << 16 else "<u4" for x in (vocabularies.a, vocabularies.b)]
        raw = [batch[c].to_pylist() for c in "ab"]
        self.a, self.b = (np.frombuffer(b"".join(x), k).astype(np.int64) for x, k in zip(raw, kinds))
        self.n_a, self.n_b = (np.array([len(r) // int(k[2]) for r in x], np.int64) for x, k in zip(raw, kinds))
        starts = [batch[c].to_numpy() for c in ("start_a", "start_b")]
        low = np.minimum(*starts)
        ends, spans = [], []
        for ids, counts, start, table in ((self.a, self.n_a, starts[0], vocabularies.length_a), (self.b, self.n_b, starts[1], vocabularies.length_b)):
            reach = np.concatenate([[0], np.cumsum(table[ids])])
            edges = np.concatenate([[0], np.cumsum(counts)])
            ends.append(reach[1:] - np.repeat(reach[edges[:-1]] - (start - low), counts))
            spans.append(reach[edges[1:]] - reach[edges[:-1]] + start - low)
        span = np.maximum(*spans) + 1
        base = np.cumsum(span) - span
        self.ends = [e + np.repeat(base, n) for e, n in zip(ends, (self.n_a, self.n_b))]
        mark = np.zeros(int(span.sum()) + 1, bool)
        mark[self.ends[0]] = True
        self.last_b = mark[self.ends[1]]
        mark[:] = False
        mark[self.ends[1]] = True
        self.last_a = mark[self.ends[0]]
        self.linked_a, self.linked_b = self.a[self.last_a], self.b[self.last_b]
        self.links = np.bincount(np.repeat(np.arange(len(self.n_a)), self.n_a)[self.last_a], minlength=len(self.n_a))


def pair_counts(pieces: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``a, b, n``: how often each pair of ids is linked in all texts."""

    def run(batches):
        vocabularies = _worker(Vocabularies, path_a, path_b)
        total = np.zeros(vocabularies.codes, np.int64)
        ids = np.zeros((2, vocabularies.codes), np.int32)
        for batch in slices(batches, 256):
            merged = Merged(batch, vocabularies)
            codes = vocabularies.code(merged.linked_a, merged.linked_b)
            total += np.bincount(codes, minlength=vocabularies.codes)
            ids[0, codes], ids[1, codes] = merged.linked_a, merged.linked_b
        held = np.flatnonzero(total)
        for part in np.array_split(held, len(held) // 50_000 + 1):
            yield pa.RecordBatch.from_arrays([pa.array(ids[0, part]), pa.array(ids[1, part]), pa.array(total[part])], ["a", "b", "n"])

    rows = pieces.select("start_a", "start_b", "a", "b").mapInArrow(run, "a int, b int, n long")
    return rows.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _texts_of(vocabularies: Vocabularies) -> list[str]:
    """Decimal ids with what follows them: of A ``,`` or, at the end of a group, ``|``; of B ``,`` or ``;``."""
    return [f"{k}{end}" for ids, ends in ((vocabularies.a, ",|"), (vocabularies.b, ",;")) for k in range(len(ids)) for end in ends]


class Counted:
    """A worker's arrays by the number of a pair: its count and whether that is the highest of the B id."""

    def __init__(self, vocabularies: Vocabularies, rows: pa.Table) -> None:
        a, b, n = (rows[c].to_numpy() for c in "abn")
        codes = vocabularies.code(a, b)
        highest = np.zeros(len(vocabularies.b), np.int64)
        np.maximum.at(highest, b, n)
        self.count = np.zeros(vocabularies.codes, np.int64)
        self.count[codes] = n
        self.best = np.zeros(vocabularies.codes, np.int64)
        self.best[codes] = n == highest[b]


def _sums(merged: Merged, vocabularies: Vocabularies, counted: Counted) -> list[np.ndarray]:
    """Links, links whose count is the highest of their B id, and counts, added for each piece."""
    codes = vocabularies.code(merged.linked_a, merged.linked_b)
    edges = np.concatenate([[0], np.cumsum(merged.links)])
    out = [merged.links]
    for values in (counted.best[codes], counted.count[codes]):
        reach = np.concatenate([[0], np.cumsum(values)])
        out.append(reach[edges[1:]] - reach[edges[:-1]])
    return out


_OUT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def _whole(make, with_groups: bool):
    """Results of texts of one piece: each ends with a common end, so no group reaches into the next text."""

    def run(batches):
        vocabularies, counted, texts = make()
        for batch in slices(batches, 256):
            m = Merged(batch, vocabularies)
            groups_a, groups_b = np.cumsum(m.last_a) - m.last_a, np.cumsum(m.last_b) - m.last_b
            closed_a, closed_b = np.flatnonzero(m.last_a) + 1, np.concatenate([[0], np.flatnonzero(m.last_b) + 1])
            order = np.empty(len(m.a) + len(m.b), np.int64)
            order[np.arange(len(m.a)) + closed_b[groups_a]] = 2 * m.a + m.last_a
            order[np.arange(len(m.b)) + closed_a[groups_b]] = 2 * (len(vocabularies.a) + m.b) + m.last_b
            shown = [texts[k] for k in order.tolist()]
            edges = [0, *np.cumsum(m.n_a + m.n_b).tolist()]
            groups = ["".join(shown[i:j])[:-1] for i, j in zip(edges, edges[1:])]
            links, best, count = _sums(m, vocabularies, counted)
            arrays = [batch["doc_id"], *(pa.array(x, pa.int64()) for x in (m.n_a, m.n_b, links, links, best, count)), pa.array(map(_digest, groups), pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(groups, pa.string())] if with_groups else [])], ["doc_id", *_OUT, "groups_sha256", *(["groups"] if with_groups else [])])

    return run


def _parts(make):
    """Of each piece: its sums; the tokens up to its first common end (all, if there is none) and behind its last; the groups between."""
    names = ["row", "doc_id", "piece", *_OUT, "closed", "head_a", "head_b", "middle", "tail_a", "tail_b"]

    def run(batches):
        vocabularies, counted, texts = make()
        shift = 2 * len(vocabularies.a)
        for batch in slices(batches, 1):
            m = Merged(batch, vocabularies)
            at_a, at_b = np.flatnonzero(m.last_a), np.flatnonzero(m.last_b)
            shown_a = [texts[k] for k in (2 * m.a).tolist()]
            shown_b = [texts[k] for k in (shift + 2 * m.b).tolist()]
            middle = []
            for i, j, k, n in zip(at_a, at_a[1:], at_b, at_b[1:]):
                middle.append("".join(shown_a[i + 1 : j + 1])[:-1] + "|" + "".join(shown_b[k + 1 : n + 1])[:-1])
            closed = len(at_a) > 0
            first_a, first_b = (at_a[0] + 1, at_b[0] + 1) if closed else (len(m.a), len(m.b))
            after_a, after_b = (at_a[-1] + 1, at_b[-1] + 1) if closed else (len(m.a), len(m.b))
            hung = ["".join(x) for x in (shown_a[:first_a], shown_b[:first_b], shown_a[after_a:], shown_b[after_b:])]
            links, best, count = (int(x[0]) for x in _sums(m, vocabularies, counted))
            sums = [[int(x)] for x in (m.n_a[0], m.n_b[0], links, links, best, count)]
            arrays = [batch["row"], batch["doc_id"], batch["piece"], *(pa.array(x, pa.int64()) for x in sums), pa.array([closed])]
            arrays += [pa.array([x], pa.string()) for x in (hung[0], hung[1], ";".join(middle), hung[2], hung[3])]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def _stitched(with_groups: bool):
    """Pieces of one text next to each other and in order: its result. What hangs over waits for the next common end."""

    def run(batches):
        row, doc_id, sums, state, kept = None, None, [], None, []
        open_a, open_b, done = [], [], []

        def add(text: str) -> None:
            nonlocal some
            if text:
                state.update((";" if some else "").encode() + text.encode())
                some = True
                if with_groups:
                    kept.append(text)

        def result():
            return (doc_id, *sums, state.hexdigest() if some else "", *([";".join(kept)] if with_groups else []))

        some = False
        for batch in batches:
            for r in batch.to_pylist():
                if r["row"] != row:
                    if row is not None:
                        done.append(result())
                    row, doc_id, sums, state, some, open_a, open_b = r["row"], r["doc_id"], [0] * 6, hashlib.sha256(), False, [], []
                    kept = []
                sums = [x + r[c] for x, c in zip(sums, _OUT)]
                open_a.append(r["head_a"])
                open_b.append(r["head_b"])
                if r["closed"]:
                    add("".join(open_a)[:-1] + "|" + "".join(open_b)[:-1])
                    add(r["middle"])
                    open_a, open_b = [r["tail_a"]], [r["tail_b"]]
            if done:
                yield out(done)
                done.clear()
        if row is not None:
            yield out([result()])

    def out(rows):
        kinds = [pa.int64()] * 7 + [pa.string()] * (1 + with_groups)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", *_OUT, "groups_sha256", *(["groups"] if with_groups else [])])

    return run


def align(docs: DataFrame, path_a: str, path_b: str, size: int = SIZE, with_groups: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and, with
    ``with_groups``, the ``groups`` themselves as ``a1,a2|b1;a3|b2,b3``.

    ``path_a``: byte-level file of the ``tokenizers`` library; ``path_b``: model of ``sentencepiece``. ``n_best`` counts links whose pair is the
    most frequent of its B id in all texts; ``count_sum`` adds the counts of the links' pairs.
    """
    if size < 2:
        raise ValueError("a piece holds two ends at least")
    pieces = token_pieces(docs, path_a, path_b, size)
    counts = pair_counts(pieces, path_a, path_b).toArrow()  # at most ``Vocabularies.codes`` rows
    shared = docs.sparkSession.sparkContext.broadcast([counts[c].to_numpy() for c in "abn"])

    def make():
        vocabularies = _worker(Vocabularies, path_a, path_b)
        a, b, n = shared.value
        return vocabularies, Counted(vocabularies, {"a": pa.array(a), "b": pa.array(b), "n": pa.array(n)}), _texts_of(vocabularies)

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in _OUT) + ", groups_sha256 string" + (", groups string" if with_groups else "")
    whole = pieces.where("pieces = 1").select("doc_id", "start_a", "start_b", "a", "b").mapInArrow(_whole(make, with_groups), schema)
    parts = ", ".join(["row long, doc_id long, piece int", *(f"{c} long" for c in _OUT), "closed boolean", *(f"{c} string" for c in ("head_a", "head_b", "middle", "tail_a", "tail_b"))])
    cut = pieces.where("pieces > 1").select("row", "doc_id", "piece", "start_a", "start_b", "a", "b").mapInArrow(_parts(make), parts)
    ordered = cut.repartition("row").sortWithinPartitions("row", "piece")
    return whole.unionByName(ordered.mapInArrow(_stitched(with_groups), schema))
