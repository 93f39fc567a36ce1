"""Near copies by Jaccard similarity of word n-grams: rare-first prefix filtering.

A text's grams are ordered rarest first by corpus counts. Two sets can only reach the threshold if
they share a gram among the first ``n - ceil(t n) + 1`` of each, so only those are joined. Pairs must
also pass the length filter, the positional filter (grams left after the shared one) and the suffix
filter (the sizes of the sets' parts under a fixed partition bound their symmetric difference).
Pairs that pass are verified once on the whole sets.

Corpus counts come from a count-min table over all grams of all texts: one table row of ``WIDTH``
counters, added up by Spark in blocks. Counts order the grams only; any total order gives the same
links, so an over-count costs time and never a link.

Defined results: null or empty text and text without words has an empty set and no links. Rows with
one ``doc_id`` are one document. A null ``doc_id`` is returned with a null component. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.llm import kernels
from cutline.llm.graph import connect
from cutline.llm.store import shuffles_freed, stored

#: Words are runs of characters outside ASCII white space.
WORD_BYTES = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
#: Counters of corpus counts: 4 MB, whatever the corpus size.
WIDTH = 1 << 20
_BLOCK = 1 << 14
#: Parts of the suffix filter.
PARTS = 32
_PLACE = tuple(0x9E3779B97F4A7C15 * (2 * i + 3) % (1 << 64) | 1 for i in range(64))


def gram_sets(hasher, data, bounds, size: int):
    """Per text the sorted distinct grams, as flat values with their text number and lengths."""
    starts, _, words, first = hasher(data, bounds)
    count = np.diff(first)
    per_text = np.maximum(count - size + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(count)), per_text)
    begin = np.cumsum(per_text) - per_text
    at = np.arange(len(owner)) - begin[owner] + first[:-1][owner]
    span = np.minimum(count, size)[owner]
    grams = np.zeros(len(owner), np.uint64)
    for i in range(size):
        there = span > i
        grams[there] += kernels.mix(words[at[there] + i]) * np.uint64(_PLACE[i])
    grams = kernels.mix(grams + span.astype(np.uint64))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[fresh], owner[fresh]
    return grams, owner, np.bincount(owner, minlength=len(count))


def _counting(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = kernels.WordHasher(WORD_BYTES)
        table = np.zeros(WIDTH, np.int64)
        for batch in batches:
            for _, _, data, bounds in kernels.chunks(batch.column(0)):
                grams, _, _ = gram_sets(hasher, data, bounds, size)
                table += np.bincount((grams >> np.uint64(44)).astype(np.int64), minlength=WIDTH)
        blocks = table.reshape(-1, _BLOCK)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(blocks)), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary())],
            ["block", "counts"],
        )

    return run


def _adding(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_BLOCK, np.int64)
    for batch in tables:
        for counts in batch.column("counts").to_pylist():
            total += np.frombuffer(counts, np.int64)
    ranks = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([ranks.tobytes()], pa.binary())], ["block", "counts"])


def corpus_counts(docs: DataFrame, size: int) -> np.ndarray:
    """The count-min table over all grams; 4 MB reach the driver, at any corpus size."""
    parts = docs.select("text").mapInArrow(_counting(size), "block int, counts binary")
    rows = parts.groupBy("block").applyInArrow(_adding, "block int, counts binary").collect()
    table = np.zeros(WIDTH, np.int32)
    for block, counts in rows:
        table[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(bytes(counts), np.int32)
    return table


def _sketching(counts, size: int, percent: int):
    """Per document: set size, two sums that identify the set, part sizes, and the rare prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = kernels.WordHasher(WORD_BYTES)
        table = counts.value
        for batch in batches:
            for row, last, data, bounds in kernels.chunks(batch.column(1)):
                grams, owner, n = gram_sets(hasher, data, bounds, size)
                texts = len(n)
                total = np.zeros(len(grams) + 1, np.uint64)
                np.cumsum(kernels.mix(grams + np.uint64(1)), out=total[1:])
                ends = np.cumsum(n)
                one = total[ends] - total[ends - n]
                np.cumsum(kernels.mix(grams ^ np.uint64(0xABCDEF)), out=total[1:])
                two = total[ends] - total[ends - n]
                part = (grams & np.uint64(PARTS - 1)).astype(np.int64)
                parts = np.bincount(owner * PARTS + part, minlength=texts * PARTS).astype(np.int32)
                rare = table[(grams >> np.uint64(44)).astype(np.int64)]
                order = np.lexsort((grams, rare, owner))
                place = np.arange(len(grams)) - (ends - n)[owner]
                least = -(-percent * n // 100)
                prefix = np.where(n > 0, n - least + 1, 0)
                chosen = grams[order][place < prefix[owner]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, last - row).cast(pa.int64()),
                        pa.array(n.astype(np.int64)),
                        pa.array(one.view(np.int64)),
                        pa.array(two.view(np.int64)),
                        kernels.lists(parts, np.full(texts, PARTS), pa.int32()),
                        kernels.lists(chosen.view(np.int64), prefix, pa.int64()),
                    ],
                    ["doc_id", "n", "one", "two", "parts", "prefix"],
                )

    return run


def _listing(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = kernels.WordHasher(WORD_BYTES)
        for batch in batches:
            for row, last, data, bounds in kernels.chunks(batch.column(1)):
                grams, _, n = gram_sets(hasher, data, bounds, size)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, last - row).cast(pa.int64()), kernels.lists(grams.view(np.int64), n, pa.int64())],
                    ["id", "grams"],
                )

    return run


def near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text).

    Two documents link when 100 * |A & B| >= percent * |A | B| over their sets of ``size`` words.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    counts = spark.sparkContext.broadcast(corpus_counts(docs, size))
    sketches = stored(
        docs.mapInArrow(
            _sketching(counts, size, percent),
            "doc_id bigint, n bigint, one bigint, two bigint, parts array<int>, prefix array<bigint>",
        ),
        "sketches",
    )
    # Equal sets are one class under their smallest document.
    same = ["n", "one", "two"]
    known = sketches.where("n > 0 and doc_id is not null")
    classes = stored(known.groupBy(*same).agg(F.min("doc_id").alias("id")), "classes")
    heads = known.join(classes.withColumnRenamed("id", "doc_id"), [*same, "doc_id"], "left_semi").dropDuplicates(same)
    heads = heads.select(F.col("doc_id").alias("id"), "n", "parts", "prefix")
    postings = heads.select("id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "key"))
    postings = postings.select("key", "id", "n", (F.col("n") - F.col("pos")).alias("left"))

    # A part's size is odd or even: one bit each of the parity bitmap.
    odd = F.transform("parts", lambda p, i: F.call_function("shiftleft", p.cast("bigint").bitwiseAND(F.lit(1)), i))
    bits = F.aggregate(odd, F.lit(0).cast("bigint"), lambda all_, bit: all_.bitwiseOR(bit))
    parts = heads.select("id", "n", "parts", bits.alias("bits0"), F.lit(0).cast("bigint").alias("bits1"))

    def prepared(ids: DataFrame) -> DataFrame:
        """Set sizes and part sizes of the documents that share a prefix gram."""
        return stored(parts.join(ids, "id"), "parts")

    def verified(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
        apart = F.aggregate(
            F.zip_with("x.parts", "y.parts", lambda p, q: F.abs(p - q)), F.lit(0), lambda s, v: s + v
        )
        room = F.expr(f"x.n + y.n - 2 * ceil({percent} * (x.n + y.n) / {100 + percent})")
        passed = stored(
            pairs.join(sizes.select(F.col("id").alias("a"), F.struct("n", "parts").alias("x")), "a")
            .join(sizes.select(F.col("id").alias("b"), F.struct("n", "parts").alias("y")), "b")
            .where(apart <= room)
            .select("a", "b"),
            "passed",
        )
        wanted = passed.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = stored(
            docs.join(wanted, "doc_id", "left_semi")
            .select("doc_id", "text")
            .mapInArrow(_listing(size), "id bigint, grams array<bigint>")
            .dropDuplicates(["id"]),
            "sets",
        )
        common = F.size(F.array_intersect("g", "h"))
        return (
            passed.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("g")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("grams").alias("h")), "b")
            .where(common * 100 >= (F.size("g") + F.size("h") - common) * percent)
            .select("a", "b")
        )

    with shuffles_freed(spark):
        found = connect(postings, prepared, verified, percent)
    grouped = classes.join(found, "id", "left").select(*same, F.coalesce("component", "id").alias("component_id"))
    return (
        sketches.select("doc_id", *same)
        .join(grouped, same, "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        )
    )
