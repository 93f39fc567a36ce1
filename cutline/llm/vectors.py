"""Embedding near copies by iterative quantisation and multi-index Hamming tables.

A rotation of the principal directions is learned on at most ``SAMPLE`` vectors (chosen by hash) so
that the signs of the rotated vectors are balanced bits. Every vector is coded. Codes are cut into
chunks; two vectors are candidates when a chunk differs in at most one bit and the whole codes in at
most a radius of their bits. Candidates are ranked by their original vectors in double precision.
Chunks widen with the number of vectors, so tables hold about as many rows per cell at any size. A wide
chunk meets fewer pairs, so chunks of further rotations are added until ``RECALL`` of the pairs at the
threshold itself, planted around vectors of the sample, are met. A planted pair differs in the direction of
a near vector of the sample, so it lies where real pairs lie, also when all vectors share a subspace or a
component; a third differ towards any vector of the sample and a third in any direction, and each third has
to be met. When over
``TABLES`` would be needed, chunks are made narrower: more candidates to rank, not fewer pairs.

Equal vectors are one class with a weight, so many copies of one vector cost one row, and links count
all of them. No cell, candidate list or link list is capped.

Defined results: a vector that is null, zero, or has null or non-finite components links with
nothing, as does one whose length differs from all others. A null vec_id is its own row with a null component. Repeated rows are
classes of equal vectors; a vec_id that repeats is one vector per row. An empty table is empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.llm.graph import components
from cutline.llm.store import stored

SAMPLE = 20_000
ROUNDS = 50
#: Differing bits allowed at least, as a share of the code: over six standard deviations above the mean at 0.97.
RADIUS = 0.3
#: Share of planted pairs at the threshold that the tables meet, and their number.
RECALL = 0.95
PLANTED = 6000
#: Tables before chunks are made a bit narrower.
TABLES = 48


def rotation(vectors: np.ndarray, bits: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (dimensions x bits) whose signs lie closest to the rotated sample."""
    mean = vectors.mean(axis=0)
    centred = vectors - mean
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    axes = axes[:bits].T
    reduced = centred @ axes
    turn = np.linalg.qr(np.random.default_rng(7).normal(size=(axes.shape[1], axes.shape[1])))[0]
    for _ in range(rounds):
        code = np.where(reduced @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(reduced.T @ code)
        turn = left @ right
    return mean, axes @ turn


def layout(bits: int, n: int) -> tuple[int, int]:
    """Chunks of a code, and their width, for ``n`` vectors."""
    width = max(1, min(bits, max(8, math.ceil(math.log2(max(n, 2))) - 4)))
    chunks = max(1, bits // width)
    return chunks, bits // chunks


def planted(vectors: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at cosine ``least``: x from the sample, y away from it towards its nearest
    vector below the threshold (first third), to any other (second) or in any direction (last)."""
    rng = np.random.default_rng(11)
    x = np.resize(vectors[:PLANTED], (PLANTED, vectors.shape[1]))
    side = rng.normal(size=x.shape)
    third = PLANTED // 3
    side[third : 2 * third] = vectors[rng.integers(0, len(vectors), third)]
    for a in range(0, third, 500):
        own = x[a : a + 500]
        near = own @ vectors.T
        near[near > least] = -2
        best = near.argmax(axis=1)
        found = near[np.arange(len(own)), best] > -1
        side[a : a + 500][found] = vectors[best[found]]
    own = np.abs((side * x).sum(axis=1)) > (1 - 1e-9) * np.linalg.norm(side, axis=1)
    side[own] = rng.normal(size=(own.sum(), x.shape[1]))
    side -= (side * x).sum(axis=1, keepdims=True) * x
    side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-12)
    return x, least * x + math.sqrt(max(0.0, 1 - least * least)) * side


def tabled(vectors: np.ndarray, model: tuple[np.ndarray, np.ndarray], least: float, n: int) -> tuple[list[np.ndarray], int, int, int]:
    """Projections, number of tables, width of a chunk and radius that meet pairs at cosine ``least`` among ``n`` vectors."""
    mean, projection = model
    bits = projection.shape[1]
    x, y = planted(vectors, least)
    rng = np.random.default_rng(13)
    turns, apart = [], []

    def differing(k: int) -> np.ndarray:
        while len(turns) <= k:
            turns.append(projection @ np.linalg.qr(rng.normal(size=(bits, bits)))[0] if turns else projection)
            apart.append(((x - mean) @ turns[-1] >= 0) != ((y - mean) @ turns[-1] >= 0))
        return apart[k]

    radius = max(int(RADIUS * bits), int(np.quantile(differing(0).sum(axis=1), 0.999)))
    for width in range(layout(bits, n)[1], 0, -1):
        chunks = bits // width
        met = np.zeros(PLANTED, bool)
        for t in range(max(chunks, TABLES)):
            i = t % chunks * width
            met |= differing(t // chunks)[:, i : i + width].sum(axis=1) <= 1
            if t + 1 >= chunks and met.reshape(3, -1).mean(axis=1).min() >= RECALL:
                return turns[: t // chunks + 1], t + 1, width, radius
    # One bit that may differ excludes nothing.
    return turns[:1], 1, 1, radius


def _coding(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, turns = model.value
        place = np.uint64(1) << np.arange(turns[0].shape[1], dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(batch.num_rows, -1)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            codes = [(((x - mean) @ turn >= 0) * place).sum(axis=1, dtype=np.uint64) for turn in turns]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(c.view(np.int64)) for c in codes]],
                ["id", "v", *[f"code{k}" for k in range(len(codes))]],
            )

    return run


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).withColumn(
        "ok", F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    )
    rows = rows.withColumn("h", F.when(F.col("ok"), F.sha2(F.to_json(F.struct("v")), 256)))
    rows = stored(rows, "vectors")
    good = rows.where("ok")
    classes = stored(
        good.groupBy("h").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first("v").alias("v"), F.min(F.size("v")).alias("dim"))
        .withColumn("id", F.monotonically_increasing_id()),
        "vector-classes",
    )
    links = None
    for dim, n in sorted((r["dim"], r["count"]) for r in classes.groupBy("dim").count().collect()):
        own = classes.where(F.col("dim") == dim)
        share = min(1.0, SAMPLE / n)
        sample = own.where(F.pmod(F.xxhash64("h", F.lit("fit")), F.lit(1_000_000)) < max(1, int(share * 1_000_000))).select("v").limit(2 * SAMPLE).toPandas()
        x = np.array(sample["v"].tolist(), float).reshape(len(sample), -1)
        if len(x) < 2:
            x = np.vstack([np.eye(dim), -np.eye(dim)])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        model = rotation(x, min(dim, 64))
        turns, tables, width, radius = tabled(x, model, least, n)
        names = [f"code{k}" for k in range(len(turns))]
        coded = stored(
            own.select("id", "v").mapInArrow(
                _coding(spark.sparkContext.broadcast((model[0], turns))), "id bigint, v array<double>, " + ", ".join(f"{c} bigint" for c in names)
            ),
            "codes",
        )
        found = _pairs(coded.select("id", *names), model[1].shape[1], tables, width, radius)
        pairs = stored(found, "candidates")
        dot = F.aggregate(F.zip_with("p", "q", lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y))
        unit = coded.select("id", F.transform("v", lambda y: y / norm).alias("u"))
        near = (
            pairs.join(unit.select(F.col("id").alias("a"), F.col("u").alias("p")), "a")
            .join(unit.select(F.col("id").alias("b"), F.col("u").alias("q")), "b")
            .where(dot >= least)
            .select("a", "b")
        )
        links = near if links is None else links.unionByName(near)
    if links is None:
        links = spark.createDataFrame([], "a bigint, b bigint")
    links = stored(links, "vector-links")
    weight = classes.select("id", "weight")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    count = both.join(weight.withColumnRenamed("id", "b"), "b").groupBy("a").agg(F.sum("weight").alias("more"))
    found = components(links)
    grouped = classes.join(found, "id", "left").join(count.withColumnRenamed("a", "id"), "id", "left").select(
        "h", "low", F.coalesce("component", "id").alias("g"), (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")
    )
    lowest = grouped.groupBy("g").agg(F.min("low").alias("component_id"))
    judged = grouped.join(lowest, "g").select("h", "n_links", "component_id")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", "h").join(judged, "h", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _pairs(codes: DataFrame, bits: int, tables: int, width: int, radius: int) -> DataFrame:
    """(a, b) of codes that agree but for one bit in some chunk and for ``radius`` in all; each pair once."""
    chunks = bits // width
    names = [c for c in codes.columns if c != "id"]
    mask = F.lit((1 << width) - 1).cast("bigint")

    def chunk(code, t: int):
        return F.shiftrightunsigned(code, t % chunks * width).bitwiseAND(mask)

    held = codes.select("id", *names, F.posexplode(F.array(*[chunk(F.col(names[t // chunks]), t) for t in range(tables)])).alias("t", "key"))
    # Of two chunks that differ in one bit, the one without the bit asks for the other.
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << i).cast("bigint") for i in range(width)])
    asked = held.select(
        F.col("id").alias("a"), *[F.col(c).alias(f"a{c}") for c in names], "t",
        F.explode(F.transform(F.filter(flips, lambda f: F.col("key").bitwiseAND(f) == 0), lambda f: F.struct(f.alias("flip"), F.col("key").bitwiseOR(f).alias("key")))).alias("ask"),
    ).select("a", *[f"a{c}" for c in names], "t", (F.col("ask.flip") == 0).alias("same"), F.col("ask.key").alias("key"))
    apart = [F.col(f"a{c}").bitwiseXOR(F.col(c)) for c in names]
    # A pair met in several tables counts in the first of them.
    earlier = F.lit(False)
    for i in range(tables):
        earlier = earlier | ((F.lit(i) < F.col("t")) & (F.bit_count(chunk(apart[i // chunks], i)) <= 1))
    return (
        asked.join(held, ["t", "key"])
        .where((~F.col("same") | (F.col("a") < F.col("id"))) & (F.bit_count(apart[0]) <= radius) & ~earlier)
        .select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"))
    )
