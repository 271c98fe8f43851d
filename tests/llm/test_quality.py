from __future__ import annotations

import random
import zlib

import numpy as np

from quadrante.llm.quality import fit_pu, keep_good, score, train
from tests.llm.conftest import odd_rows, prose


def corpus():
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(400):
        good = rng.random() < 0.8
        text = prose(k, rng.randrange(30, 200))
        if not good:
            text = " ".join([w + rng.choice(["$$$", "!!", "###"]) for w in text.upper().split()]) if k % 2 else " ".join([w for w in text.split()[:9] for _ in range(9)])
        rows.append((k, text))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, int(good), 0))
    return rows, labels, {k: int(t == prose(k, len(t.split()))) for k, t in rows}


def test_held_out_accuracy_and_columns(spark, documents):
    rows, labels, truth = corpus()
    frame = spark.createDataFrame([*labels, (None, 1, 0), (0, None, 1)], "doc_id long, quality int, toxic int")
    docs = documents([*rows, (None, rows[0][1]), (5000, None), (5001, "")])
    model = train(docs, frame)
    got = score(docs, model).collect()
    assert len(got) == len(rows) + 3 and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted"}
    by_id = {r["doc_id"]: r for r in got}
    for k, r in by_id.items():
        assert r["held_out"] == (k is not None and zlib.crc32(str(k).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    out = [k for k in truth if by_id[k]["held_out"]]
    assert np.mean([by_id[k]["predicted"] == truth[k] for k in out]) > 0.95
    kept = keep_good(docs, model)
    assert kept.schema == docs.schema and {r["doc_id"] for r in kept.collect()} == {k for k, r in by_id.items() if r["predicted"]}


def test_held_out_labels_are_not_learnt(spark, documents):
    rows, labels, _ = corpus()
    flipped = [(k, 1 - q if zlib.crc32(str(k).encode()) % 4 == 2 else q, t) for k, q, t in labels]
    one, two = (train(documents(rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flipped))
    assert np.array_equal(one.weights, two.weights) and one.slope == two.slope


def test_risk_is_kept_from_negative_values():
    rng = np.random.default_rng(1)
    positive, negative = rng.normal(1.5, 1, (300, 18)), rng.normal(-1.5, 1, (120, 18))
    model = fit_pu(positive, np.vstack([positive[:180], negative]), 0.6)
    assert (model.raw(positive) > 0).mean() > 0.95 and (model.raw(negative) < 0).mean() > 0.95


def test_without_labels_or_documents(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(odd_rows())
    assert train(docs, none) is None and {r["score"] for r in score(docs, None).collect()} == {0.5}
    assert keep_good(docs, None).count() == len(odd_rows()) and score(documents([]), None).count() == 0
