"""Best-fit packing by a configuration linear program over the length histogram.

The histogram has at most ``capacity`` rows, whatever the corpus size, so the program is solved on
the driver: multiplicative weights price the lengths, a bounded knapsack finds the best
configuration at those prices, and the covering solution is rounded down. The lengths left over are
packed one configuration at a time by the same knapsack. Spark then ranks the pieces of each length
and looks their places up in the table of configurations.

Ranks come from salted row numbers plus running totals per salt, so a length that holds a third of
all pieces is not one task's group.

Defined results: null text reads as empty (one end token); rows that repeat are packed each; an empty
table gives an empty result. Pieces must be no longer than ``capacity`` and at least 1.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cutline.llm import kernels
from cutline.llm.store import stored

ROUNDS = 300
STEP = 0.3
#: Pieces that share a salt, on average over all lengths, and the most salts: running totals per
#: length are summed over this many rows at most.
SALT_ROWS = 4096
SALTS = 1 << 16


class Knapsack:
    """Best value of a sequence, with at most ``most[l]`` pieces of each length."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def __call__(self, lengths: np.ndarray, most: np.ndarray, values: np.ndarray) -> dict[int, int]:
        best = np.zeros(self.capacity + 1)
        taken = []
        for length, bound, value in zip(lengths.tolist(), most.tolist(), values.tolist()):
            size = 1
            while bound > 0:
                size = min(size, bound)
                bound -= size
                weight = size * length
                if weight > self.capacity:
                    break
                with_it = best[:-weight] + size * value
                better = with_it > best[weight:] + 1e-12
                best[weight:][better] = with_it[better]
                taken.append((length, size, better))
                size *= 2
        room, chosen = int(np.argmax(best)), {}
        for length, size, better in reversed(taken):
            weight = size * length
            if room >= weight and better[room - weight]:
                chosen[length] = chosen.get(length, 0) + size
                room -= weight
        return chosen


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Configurations (times, {length: pieces}) that hold every piece of the histogram once."""
    plan = [(histogram[capacity], {capacity: 1})] if histogram.get(capacity) else []
    lengths = np.array(sorted((n for n, c in histogram.items() if c and n < capacity), reverse=True), np.int64)
    left = np.array([histogram[n] for n in lengths], np.int64)
    if not len(lengths):
        return plan
    place = {int(n): i for i, n in enumerate(lengths)}
    pack = Knapsack(capacity)
    fit = capacity // lengths

    # Covering by multiplicative weights: lengths that are behind grow dearer.
    need, cover = left.astype(float), np.zeros(len(lengths))
    price = lengths / capacity
    amount: dict[tuple, float] = {}
    for _ in range(ROUNDS):
        chosen = pack(lengths, np.minimum(left, fit), price)
        if not chosen:
            break
        key = tuple(sorted(chosen.items()))
        at = np.array([place[n] for n, _ in key])
        pieces = np.array([k for _, k in key], float)
        times = STEP * float(np.min(need[at] / pieces))
        amount[key] = amount.get(key, 0.0) + times
        cover[at] += times * pieces / need[at]
        price = lengths / capacity * np.exp(-(cover - cover.min()))
    # Round down at full cover of the furthest length, then fill what is left.
    scale = 1.0 / max(cover.max(), 1e-9)
    for key, times in sorted(amount.items(), key=lambda x: -x[1]):
        n = min([int(times * scale), *(int(left[place[a]] // k) for a, k in key)])
        if n > 0 and sum(a * k for a, k in key) == capacity:
            plan.append((n, dict(key)))
            for a, k in key:
                left[place[a]] -= n * k
    while left.any():
        open_ = left > 0
        own = lengths[open_]
        # Fuller sequences first, among them those with longer pieces.
        chosen = pack(own, np.minimum(left, fit)[open_], own + 0.25 * (own / capacity) ** 2)
        n = min(int(left[place[a]] // k) for a, k in chosen.items())
        plan.append((n, chosen))
        for a, k in chosen.items():
            left[place[a]] -= n * k
    return plan


def pack(pieces: DataFrame, order: list[str], capacity: int) -> DataFrame:
    """``pieces`` (length, ...) with sequence_id and offset; ``order`` names columns that fix ranks."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("length").count().collect()
    total = sum(r["count"] for r in counts)
    plan = solve({int(r["length"]): int(r["count"]) for r in counts}, capacity)
    runs, seen, sequence = [], {}, 0
    for times, config in plan:
        offset = 0
        for length, k in sorted(config.items(), reverse=True):
            first = seen.get(length, 0)
            runs.append((length, first, first + times * k, sequence, k, offset))
            seen[length] = first + times * k
            offset += length * k
        sequence += times
    table = spark.createDataFrame(
        runs, "length long, first long, until long, sequence long, each long, base long"
    )
    salts = max(1, min(SALTS, total // SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n"))
        .drop("n")
    )
    ranked = salted.withColumn(
        "rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order)) - 1
    ).join(before, ["length", "salt"])
    rank = F.col("rank") + F.col("before")
    # At most a few rows per configuration and length: the histogram bounds the table.
    placed = ranked.withColumn("rank", rank).join(F.broadcast(table), "length").where("rank >= first and rank < until")
    return placed.select(
        *pieces.columns,
        F.expr("sequence + (rank - first) div each").alias("sequence_id"),
        F.expr("base + (rank - first) % each * length").alias("offset"),
    )


def _encoder(vocabulary: str):
    """The tokenizer of this worker, read once. Both libraries hold one vocabulary and agree."""
    kept = sys.modules.setdefault("_cutline_worker", types.ModuleType("_cutline_worker")).__dict__
    if vocabulary not in kept:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(public_tokenizers.path(vocabulary + ".tiktoken"), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        kept[vocabulary] = fast, Tokenizer.from_file(public_tokenizers.path(vocabulary + ".json"))
    return kept[vocabulary]


def _encoding(vocabulary: str, end: int, capacity: int, special: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fast, exact = _encoder(vocabulary)
        for batch in batches:
            docs, piece, start, length, crc = [], [], [], [], []
            for at, (doc, text) in enumerate(zip(batch.column(0), batch.column(1))):
                text = text.as_py() or ""
                if special in text:
                    ids = exact.encode(text, add_special_tokens=False).ids
                else:
                    ids = fast.encode_ordinary(text)
                raw = np.array([*ids, end], "<u4")
                first = (len(raw) - 1) % capacity + 1
                cuts = [0, *range(first, len(raw) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    docs.append(at)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(docs, pa.int64())).cast(pa.int64()),
                    pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def pack_documents(
    docs: DataFrame, vocabulary: str = "byte_bpe_50k", end: int = 2, capacity: int = 1024, special: str = "<|endoftext|>"
) -> DataFrame:
    """Every piece of every document (doc_id, text) with its place in a packed sequence."""
    pieces = stored(
        docs.select("doc_id", "text").mapInArrow(
            _encoding(vocabulary, end, capacity, special),
            "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint",
        ),
        "pieces",
    )
    return pack(pieces, ["doc_id", "piece", "start", "ids_crc32"], capacity)
