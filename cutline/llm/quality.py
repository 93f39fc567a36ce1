"""Quality by a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into halves of ``HALF`` bytes, and every two neighbouring halves are a chunk, so
chunks overlap by half and cover the whole text. ``FILTERS`` filters over ``WIDTH`` bytes (one weight for
every byte at every place) slide over all places; a half keeps each filter's largest response, at least
zero, and a chunk the larger of its two halves. A linear layer over these and the share of the chunk that
is empty makes a chunk's probability, and a logistic layer over the mean, least and largest chunk probability and the number of chunks makes the text's.

Filters and both layers are learned with Adam and Newton steps on the driver, on at most ``FIT_DOCS``
labelled documents of each label (chosen by hash of their id) and ``FIT_CHUNKS`` chunks at places drawn
from their whole texts. The last layer sees these documents whole, weighted by how many of each label
there are. Scoring reads every byte of every text; memory follows the longest text.

Defined results: null and empty texts are one chunk of nothing. Rows with a null label are not learned
from, and a doc_id with both labels counts as 0. Without rows of both labels the score is the share of
label 1, or 0.5 without any. A doc_id that repeats is scored per row; a null doc_id is scored, not held
out. Other columns are never read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.llm import kernels

HALF = 128
WIDTH = 6
FILTERS = 16
FIT_DOCS = 3000
FIT_CHUNKS = 32_000
#: Chunks drawn from one document, and passes over all of them.
DRAWN = 8
EPOCHS = 10
#: Share of the drawn chunks that are cut short, as short texts are rare among the labelled.
SHORTENED = 0.35
BATCH = 64
#: Places whose responses are held at once.
_BLOCK = 256 * HALF


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def laid_out(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each filled to whole halves with zeros that no window of a text outreaches, and their numbers of halves."""
    sizes = np.diff(bounds)
    halves = -(-(sizes + WIDTH - 1) // HALF)
    out = np.zeros(int(halves.sum()) * HALF + WIDTH, np.uint8)
    starts = (np.cumsum(halves) - halves) * HALF
    place = np.repeat(starts - bounds[:-1], sizes)
    out[place + np.arange(len(data))] = data
    return out, halves


def paired(weights: np.ndarray) -> np.ndarray:
    """(WIDTH / 2, 65536, filters): the weights of two neighbouring bytes at once."""
    w = weights.astype(np.float32)
    return np.stack([(w[k][:, None] + w[k + 1][None]).reshape(65536, -1) for k in range(0, len(w), 2)])


def pooled(data: np.ndarray, halves: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Largest response, at least zero, of each half to each filter."""
    n = int(halves.sum()) * HALF
    out = np.empty((n // HALF, pairs.shape[2]), np.float32)
    # Windows that begin in a text's last zeros would read the next text.
    edges = (np.cumsum(halves)[:, None] * HALF - np.arange(1, WIDTH)).ravel()
    edges.sort()
    held = np.empty((_BLOCK, pairs.shape[2]), np.float32)
    more = np.empty_like(held)
    for at in range(0, n, _BLOCK):
        size = min(_BLOCK, n - at)
        own = data[at : at + size + WIDTH].astype(np.intp)
        index = own[:-1] << 8 | own[1:]
        np.take(pairs[0], index[:size], axis=0, out=held[:size], mode="clip")
        for k in range(1, len(pairs)):
            np.take(pairs[k], index[2 * k : 2 * k + size], axis=0, out=more[:size], mode="clip")
            held[:size] += more[:size]
        held[edges[np.searchsorted(edges, at) : np.searchsorted(edges, at + size)] - at] = 0
        out[at // HALF : (at + size) // HALF] = held[:size].reshape(-1, HALF, held.shape[1]).max(axis=1)
    return np.maximum(out, 0)


def chunked(halves_max: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Filters' largest responses by chunk, and the first chunk of each text."""
    both = np.maximum(halves_max, np.vstack([halves_max[1:], halves_max[-1:]]))
    last = np.cumsum(halves) - 1
    keep = np.ones(len(both), bool)
    keep[last] = halves == 1
    both[last] = halves_max[last]
    chunks = np.maximum(1, halves - 1)
    return both[keep], np.cumsum(chunks) - chunks


def features(data: np.ndarray, bounds: np.ndarray, pairs: np.ndarray, layer: np.ndarray) -> np.ndarray:
    """(texts, 4): mean, least and largest chunk probability, and the logarithm of the number of chunks."""
    filled, halves = laid_out(data, bounds)
    best, firsts = chunked(pooled(filled, halves, pairs), halves)
    count = np.maximum(1, halves - 1)
    empty = np.zeros(len(best))
    empty[firsts + count - 1] = 1 - (np.diff(bounds) - (count - 1) * HALF) / (2 * HALF)
    z = (best.astype(float) * layer[:-2]).sum(axis=1) + empty * layer[-2] + layer[-1]
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    mean = np.add.reduceat(p, firsts) / count
    return np.column_stack([mean, np.minimum.reduceat(p, firsts), np.maximum.reduceat(p, firsts), np.log(count)])


def _drawing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks, with the bytes their last windows need, at places drawn by the row's own hash."""
    size = 2 * HALF + WIDTH - 1
    for batch in batches:
        found, labels = [], []
        for text, label, seed in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            data = (text.as_py() or "").encode()
            last = max(1, -(-(len(data) + WIDTH - 1) // HALF) - 1)
            rng = np.random.default_rng(seed & 0xFFFFFFFF)
            places = sorted(rng.choice(last, min(last, DRAWN), replace=False))
            cuts = np.where(rng.random(len(places)) < SHORTENED, rng.integers(16, 2 * HALF, len(places)), size)
            found += [data[i * HALF : i * HALF + size][:cut].ljust(size, b"\0") for i, cut in zip(places, cuts)]
            labels += [label] * len(places)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(labels, pa.int32())], ["chunk", "label"])


def learn_filters(chunks: np.ndarray, labels: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Filter weights (WIDTH, 256, FILTERS) and the linear layer (FILTERS + 2), by Adam on both labels alike."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, 0.1, (WIDTH, 256, FILTERS))
    w[:, 0] = 0
    layer = np.append(rng.normal(0, 0.3, FILTERS), [0.0, 0.0])
    share = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum())) * len(labels)
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, layer)]
    tick, span = 0, 2 * HALF
    empty = (chunks[:, :span] == 0).mean(axis=1)
    for epoch in range(EPOCHS):
        rate = 0.02 * (1 - epoch / EPOCHS)
        order = rng.permutation(len(chunks))
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x, y = chunks[rows], labels[rows]
            pairs = w.astype(np.float32)
            r = sum(pairs[j][x[:, j : j + span]] for j in range(WIDTH))
            top = r.argmax(axis=1)
            h = np.maximum(np.take_along_axis(r, top[:, None], axis=1)[:, 0], 0).astype(float)
            p = 1 / (1 + np.exp(-np.clip(h @ layer[:-2] + empty[rows] * layer[-2] + layer[-1], -30, 30)))
            dz = (p - y) * share[rows] / len(rows)
            dh = dz[:, None] * layer[:-2] * (h > 0)
            grads = [1e-5 * w, np.append(h.T @ dz, [empty[rows] @ dz, dz.sum()]) + 1e-4 * layer]
            each = np.arange(len(rows))[:, None]
            for j in range(WIDTH):
                np.add.at(grads[0][j], (x[each, top + j], np.arange(FILTERS)[None]), dh)
            tick += 1
            for value, grad, (m, s) in zip((w, layer), grads, moments):
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                value -= rate * (m / (1 - 0.9**tick)) / (np.sqrt(s / (1 - 0.999**tick)) + 1e-8)
            w[:, 0] = 0
    return w, layer


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Weighted logistic regression with a ridge, by Newton steps; the constant comes last."""
    x = np.column_stack([x, np.ones(len(x))])
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * beta
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta))
        step = np.linalg.solve(curve, grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of ids outside the held-out third, one row each."""
    rows = labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    return rows.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))


def _measuring(pairs_of, layer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = paired(pairs_of.value)
        for batch in batches:
            parts = [features(data, bounds, pairs, layer) for _, _, data, bounds in kernels.chunks(batch.column(0))]
            x = np.vstack(parts) if parts else np.zeros((0, 4))
            yield pa.RecordBatch.from_arrays([*[pa.array(x[:, k]) for k in range(4)], batch.column(1)], ["a", "b", "c", "d", "label"])

    return run


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filters, chunk layer and text layer from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality)."""
    spark = docs.sparkSession
    known = known_labels(labels)
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    order = F.xxhash64("doc_id", F.lit("fit"))
    picked = None
    for label in (0, 1):
        own = known.where(F.col("quality") == label).orderBy(order, "doc_id").limit(FIT_DOCS)
        picked = own if picked is None else picked.unionByName(own)
    # At most 2 * FIT_DOCS ids meet the texts.
    ids = spark.createDataFrame([tuple(r) for r in picked.collect()], "doc_id bigint, quality int")
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(
        "text", F.col("quality").alias("label"), F.xxhash64("doc_id").alias("seed")
    )
    drawn = rows.mapInArrow(_drawing, "chunk binary, label int").orderBy(F.xxhash64("chunk"), "chunk", "label").limit(FIT_CHUNKS).collect()
    y = np.array([r["label"] for r in drawn], float)
    if not len(y) or y.min() == y.max():
        share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        z = np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1))
        return np.zeros((WIDTH, 256, FILTERS)), np.zeros(FILTERS + 2), np.array([0, 0, 0, 0, z])
    x = np.frombuffer(b"".join(bytes(r["chunk"]) for r in drawn), np.uint8).reshape(len(drawn), -1)
    w, layer = learn_filters(x, y)
    measured = rows.select("text", "label").mapInArrow(
        _measuring(spark.sparkContext.broadcast(w), layer), "a double, b double, c double, d double, label int"
    )
    found = np.array([tuple(r) for r in measured.orderBy(F.xxhash64("a", "b", "c", "d"), "a", "b", "c", "d", "label").limit(2 * FIT_DOCS).collect()], float)
    y = found[:, 4]
    weight = np.where(y == 1, counts.get(1, 0) / max(1, y.sum()), counts.get(0, 0) / max(1, (1 - y).sum()))
    return w, layer, logistic(found[:, :4], y, weight * len(y) / max(1e-9, weight.sum()))


def _scoring(weights, layer, last):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = paired(weights.value)
        for batch in batches:
            parts = [features(data, bounds, pairs, layer) for _, _, data, bounds in kernels.chunks(batch.column(1))]
            x = np.vstack(parts) if parts else np.zeros((0, 4))
            z = (x * last[:-1]).sum(axis=1) + last[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, score) of every row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(model[0])
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_scoring(sent, model[1], model[2]), "doc_id bigint, score double")
