"""The byte network against plain loops, and its held-out accuracy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cutline.llm import catalog, kernels, quality

DOCS = "doc_id long, text string, quality string, score string"


def plain(text, w, layer):
    """Chunk probabilities of one text, place by place."""
    data = (text or "").encode()
    halves = -(-(len(data) + quality.WIDTH - 1) // quality.HALF)
    padded = data + bytes(quality.WIDTH)
    best = np.zeros((halves, w.shape[2]))
    for t in range(len(data)):
        r = sum(w[j, padded[t + j]] for j in range(quality.WIDTH))
        best[t // quality.HALF] = np.maximum(best[t // quality.HALF], r)
    chunks = [np.maximum(best[i], best[i + 1]) for i in range(halves - 1)] or [best[0]]
    empty = np.zeros(len(chunks))
    empty[-1] = 1 - (len(data) - (len(chunks) - 1) * quality.HALF) / (2 * quality.HALF)
    p = 1 / (1 + np.exp(-(np.array(chunks) @ layer[:-2] + empty * layer[-2] + layer[-1])))
    return p.mean(), p.min(), p.max(), np.log(len(p))


def test_features_against_plain_loops(monkeypatch):
    rng = np.random.default_rng(4)
    w = rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)) * 0.3
    w[:, 0] = 0
    layer = rng.normal(size=quality.FILTERS + 2) * 0.2
    texts = ["", None, "a", "é" * 61, "x" * 122, "x" * 123, "x" * 128, "abc " * 700, "ж" * 900, "q" * 127 + "z", "b" * 256]
    monkeypatch.setattr(quality, "_BLOCK", 3 * quality.HALF)
    got = np.vstack([quality.features(d, b, quality.paired(w), layer) for _, _, d, b in kernels.chunks(pa.array(texts, pa.string()))])
    assert np.allclose(got, [plain(t, w, layer) for t in texts], atol=1e-4)


def sentences(n, seed):
    rng = np.random.default_rng(seed)
    parts = ["an", "der", "tion", "he", "ou", "le", "wi", "sta", "mor", "ent"]
    out = []
    for i in range(n):
        words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(5, 200))]
        bad = i % 4 == 0
        out.append((i, " ".join(f"{w}{'#&$'[k % 3] * 3}" for k, w in enumerate(words)) if bad else " ".join(words) + ".", int(not bad)))
    return out


@pytest.fixture(scope="module")
def made(spark):
    rows = sentences(400, 1)
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, q, "x") for i, _, q in rows] + [(None, 0, "x"), (5, None, "x")], "doc_id long, quality int, text string")
    return docs, labels, quality.learn(docs, labels)


def test_held_out_accuracy_and_odd_rows(spark, made):
    docs, labels, model = made
    odd = spark.createDataFrame([(900, None, "", ""), (901, "", "", ""), (None, "an der", "", ""), (902, "tion! " * 200_000, "", ""), (1, "an der", "", "")], DOCS)
    got = quality.score(docs.unionByName(odd).repartition(3), model).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    assert len(got) == 405 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: q for i, _, q in sentences(400, 1)}
    held = [r for r in got if r["held"] and r["doc_id"] in truth and r["doc_id"] != 1]
    assert len(held) > 90 and np.mean([(r["score"] >= 0.5) == truth[r["doc_id"]] for r in held]) > 0.97
    assert [r["score"] for r in got if r["doc_id"] == 900] == [r["score"] for r in got if r["doc_id"] == 901]
    assert not any(r["held"] for r in got if r["doc_id"] is None)
    assert quality.score(spark.createDataFrame([], DOCS), model).count() == 0


def test_held_out_labels_are_never_learned_from(spark, made):
    docs, labels, model = made
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.learn(docs, turned)
    assert all(np.array_equal(a, b) for a, b in zip(model, again))


def test_one_label_or_none(spark, made):
    docs, labels, _ = made
    for own, share in ((labels.where("quality = 1"), 1.0), (labels.where("false"), 0.5)):
        got = {r["score"] for r in quality.score(docs, quality.learn(docs, own)).collect()}
        assert len(got) == 1 and abs(got.pop() - share) < 1e-5


def test_quality_of_the_table(spark):
    folder = "/root/testdata/sf0.01"
    got = catalog.queries()["op12_byte_quality"](spark, folder)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert got.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    judged = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").select("quality", "predicted").collect()
    assert np.mean([r["quality"] == r["predicted"] for r in judged]) > 0.97
