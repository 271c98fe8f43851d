from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quadrante.llm.common import shared_dir
from quadrante.llm.packing import hilbert_keys, pack, sequences
from quadrante.llm.token_files import decode_ranks, encode_ranks, read_tokens, token_digests, write_tokens
from quadrante.llm.tokens import WordTokenizer, sized
from tests.llm.conftest import odd_rows

FILES = {"byte_bpe_50k.json": 0, "word_bpe_49k.json": 1}
PATHS = {name: public_tokenizers.path(name) for name in FILES}
LIBRARY = {name: Tokenizer.from_file(path) for name, path in PATHS.items()}
OWN = {name: WordTokenizer(path, limit=50) for name, path in PATHS.items()}


def ids_of(name, text):
    return LIBRARY[name].encode(text or "", add_special_tokens=False).ids + [FILES[name]]


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from(" \n.,'aAbßéÉ1!\t́ΣσİI<|> \x00\x1c-"), max_size=30), max_size=6))
def test_words_give_the_ids_of_whole_texts(name, texts):
    got = [np.frombuffer(x, OWN[name].type).tolist() for x in OWN[name].encode(texts)]
    assert got == [ids_of(name, t)[:-1] for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_odd_words(name):
    texts = [t for _, t in odd_rows()] + ["I'll don't 'tis", "x<|endoftext|>y", " lead", "trail ", "a \n\nb", "!!! (a) [b]", "日本語 テキスト"]
    got = [np.frombuffer(x, OWN[name].type).tolist() for x in OWN[name].encode(texts)]
    assert got == [ids_of(name, t)[:-1] for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_arrow_texts_are_encoded_without_python_texts(name):
    texts = ["a\nb\nc\nd.", "a,\nb! c.", "é. \n", "", None, "x\x00y", "(a), b|c | d", "1. 2, a.b."]
    for kind in (pa.string(), pa.large_string()):
        got = OWN[name].encode(pa.array(["skipped", *texts], kind).slice(1))
        assert [np.frombuffer(x, OWN[name].type).tolist() for x in got] == [ids_of(name, t)[:-1] for t in texts]


def test_slices_are_bounded_by_bytes():
    batch = pa.record_batch({"text": ["a" * n for n in (5, 5, 30, 1, 1)] + [None, "é" * 4, "b", "b", "b"]})
    got = list(sized([batch, batch.slice(0, 0)], size=10, rows=3))
    assert [len(part) for part in got] == [2, 1, 3, 3, 1] and pa.Table.from_batches(got).combine_chunks().to_batches() == [batch]


def test_new_lower_case_words_are_encoded_in_lines(monkeypatch):
    name, calls = "word_bpe_49k.json", []
    own = WordTokenizer(PATHS[name])
    library = own._library
    monkeypatch.setattr(own, "_library", lambda texts: calls.extend(texts) or library(texts))
    letters = [a + b + c for a in "abcdefgh" for b in "éèöuiopq" for c in "xyzwσΣşı語ǆﬁ"]
    texts = [" ".join(f"{w}{v}" for v in letters[::50]) for w in letters[::7]]
    assert [np.frombuffer(x, own.type).tolist() for x in own.encode(texts)] == [ids_of(name, t)[:-1] for t in texts]
    assert len(calls) < 10  # one for each word before


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=70))
def test_codes_round_trip(ranks):
    control, data = encode_ranks(np.array(ranks, np.uint32))
    assert decode_ranks(control, data, len(ranks)).tolist() == ranks
    assert len(control) == -(-len(ranks) // 4)


def test_files_round_trip(spark, documents):
    docs = documents(odd_rows())
    files = write_tokens(docs, PATHS["byte_bpe_50k.json"], 0, shared_dir(spark))
    got = read_tokens(spark, files).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((d for d, _ in odd_rows()), key=lambda d: (d is not None, d))
    assert sorted(map(list, (r["ids"] for r in got))) == sorted(ids_of("byte_bpe_50k.json", t) for _, t in odd_rows())
    at = 0
    for r in got:
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        at += len(r["ids"])
    digests = {(r["doc_id"], r["ids_crc32"]) for r in token_digests(docs, PATHS["byte_bpe_50k.json"], 0).collect()}
    assert digests == {(r["doc_id"], zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in got}


def test_no_documents(spark, documents):
    assert token_digests(documents([]), PATHS["byte_bpe_50k.json"], 0).count() == 0
    assert pack(documents([]), PATHS["word_bpe_49k.json"]).count() == 0


def test_packing_loses_and_pads_nothing(spark, documents):
    size = 64
    pieces = pack(documents(odd_rows()), PATHS["word_bpe_49k.json"], size=size)
    rows = sorted(pieces.collect(), key=lambda r: (r["sequence_id"], r["offset"]))
    by_sequence: dict = {}
    for r in rows:
        assert r["offset"] == by_sequence.get(r["sequence_id"], 0) and r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by_sequence[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(n <= size and n & (n - 1) == 0 for n in by_sequence.values())
    want = sorted(str((d, ids_of("word_bpe_49k.json", t))) for d, t in odd_rows())
    runs: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        key = (r["doc_id"], r["doc_tokens"])
        runs.setdefault(key, []).append((r["start"], list(r["ids"])))
    total = sum(r["length"] for r in rows)
    assert total == sum(len(ids_of("word_bpe_49k.json", t)) for _, t in odd_rows())
    for doc, text in odd_rows():
        ids = ids_of("word_bpe_49k.json", text)
        own = runs[(doc, len(ids))]
        assert all(any(ids[s : s + len(p)] == p for s, p in own if s == start) for start, _ in own) and len(want) == len(odd_rows())
    assert sequences(pieces).selectExpr("sum(length)").first()[0] == total


def test_size_is_a_power_of_two(documents):
    with pytest.raises(ValueError, match="power of two"):
        pack(documents([]), PATHS["word_bpe_49k.json"], size=100)


def test_the_curve_visits_every_cell_by_single_steps():
    cells = np.array([(a, b, c, d) for a in range(4) for b in range(4) for c in range(4) for d in range(4)])
    random.Random(1).shuffle(rows := cells.tolist())
    keys = hilbert_keys(np.array(rows), bits=2)
    assert sorted(keys) == list(range(256))
    path = np.array(rows)[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()
