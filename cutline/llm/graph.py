"""Connected components and links between rows that share a key, without all pairs of a key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): component is the smallest id reachable.

    Alternates two star contractions until nothing changes. Each round is a min per node and a
    join; a node with many neighbours never becomes one task's group, because the min is combined
    before the shuffle and the join has one row per node on one side. Rows with a null end and
    links of a row with itself are ignored; an empty frame gives an empty frame.
    """
    edges = stored(
        links.where("a <> b")
        .select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        .distinct(),
        "edges",
    )
    state = _state(edges)
    while state[0]:
        # Larger neighbours of each node move to its smallest neighbour.
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        hung = (
            edges.join(least.withColumnRenamed("u", "lo"), "lo")
            .select(F.least("m", "lo").alias("lo"), "hi")
            .distinct()
        )
        # Smaller neighbours of each node, and the node, move to the smallest of them.
        root = hung.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = hung.join(root, "hi").select(
            F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi")
        )
        edges = stored(moved.where("lo <> hi").distinct(), "edges")
        after = _state(edges)
        if after == state:
            break
        state = after
    flat = edges.groupBy("hi").agg(F.min("lo").alias("component"))
    roots = edges.select(F.col("lo").alias("id")).distinct().join(
        flat.select(F.col("hi").alias("id")), "id", "left_anti"
    )
    return stored(
        flat.select(F.col("hi").alias("id"), "component").unionByName(
            roots.select("id", F.col("id").alias("component"))
        ),
        "components",
    )


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("hi", "lo"))
    ).first()
    return tuple(row)


def parity(array: str, word: int) -> Column:
    """Bitmap of a set of hashes: each one turns a bit. Sets that differ in d hashes differ in at most d bits.

    ``word`` 0 and 1 take one half of the hashes each."""
    turn = "bits ^ shiftleft(1L, cast(x >> 1 & 63 as int))"
    return F.expr(f"aggregate(filter({array}, x -> x & 1 = {word}), 0L, (bits, x) -> {turn})")


def _can_link(p: str, q: str, percent: int, words: int) -> Column:
    """Whether two sets may reach the threshold, by sizes, what is left of them, and bitmaps."""
    need = f"ceil({percent} * ({p}.n + {q}.n) / {100 + percent})"
    differ = " + ".join(f"bit_count({p}.bits[{w}] ^ {q}.bits[{w}])" for w in range(words))
    return F.expr(
        f"least({p}.n, {q}.n) * 100 >= greatest({p}.n, {q}.n) * {percent} and least({p}.left, {q}.left) >= {need}"
        f" and {differ} <= {p}.n + {q}.n - 2 * {need}"
    )


def connect(
    postings: DataFrame,
    prepared: Callable[[DataFrame], DataFrame],
    verified: Callable[[DataFrame, DataFrame], DataFrame],
    percent: int,
    leads: int = 1,
) -> DataFrame:
    """Components under the verified links among all pairs of ids that share a ``key``.

    ``postings`` holds (key, id, n, left): the size of the id's set and what of it is left from the key
    on. ``prepared`` gives what the pairs of a frame of ids are compared by, with ``bits0``, ``bits1`` and so on,
    the parity bitmap of each set: two bitmaps differ in no more places than the sets do. ``verified``
    keeps the pairs (a, b) that do link. First every id meets ``leads`` ids of each of its keys only, so a
    key with many copies costs that many pairs per copy; more leads leave fewer copies that none of them
    links to, and change no result. Then the pairs left are those across components that share a key;
    pairs inside one component need no check, as they cannot change the result. Only pairs that sizes and
    bitmaps allow leave a join: many sets that share one common passage and little else make no rows
    there. No pair is verified twice, and none that can link is left out.
    """
    several = postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = stored(postings.join(several.hint("shuffle_hash"), "key").select("key", "id", "n", "left"), "shared")
    compared = prepared(shared.select("id").distinct())
    words = sum(c.startswith("bits") for c in compared.columns)
    # One column for all words: the planner derives constraints for each choice of columns in a condition.
    marks = compared.select("id", F.array(*[f"bits{w}" for w in range(words)]).alias("bits"))
    shared = shared.join(marks, "id").select("key", F.struct("id", "n", "left", "bits").alias("y"))
    # The smallest id under several orders: XOR with a mask makes an order and takes it back.
    masks = [0x9E3779B97F4A7C15 * i & (1 << 63) - 1 for i in range(leads)]
    least = [F.min(F.col("y.id").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)) for m in masks]
    first = shared.groupBy("key").agg(F.array_distinct(F.array(*least)).alias("first"))
    first = first.select("key", F.explode("first").alias("lead"))
    stars = stored(
        shared.join(first.join(shared.select("key", F.col("y.id").alias("lead"), F.col("y").alias("x")), ["key", "lead"]), "key")
        .where("x.id <> y.id")
        .where(_can_link("x", "y", percent, words))
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        .distinct(),
        "stars",
    )
    near = stored(verified(stars, compared), "links")
    found = components(near)
    member = (
        shared.withColumn("id", F.col("y.id"))
        .join(found, "id", "left")
        .select("key", "y", F.coalesce("component", "id").alias("c"))
    )
    groups = member.groupBy("key", "c").agg(
        F.min("y.n").alias("low"),
        F.max("y.n").alias("high"),
        F.max("y.left").alias("left"),
        *[f(F.col("y.bits")[w]).alias(f"{name}{w}") for w in range(words) for f, name in ((F.bit_and, "all"), (F.bit_or, "any"))],
    )
    bits = [F.array(*[f"{name}{w}" for w in range(words)]).alias(name) for name in ("all", "any")]
    groups = groups.select("key", "c", "low", "high", "left", *bits)
    mixed = stored(
        groups.join(groups.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "key"),
        "mixed",
    )
    side = lambda name: mixed.select("key", F.struct(*[c for c in mixed.columns if c != "key"]).alias(name))
    beyond = lambda x, y, w: f"bit_count(({x}[{w}] & ~h.any[{w}]) | (h.all[{w}] & ~{y}[{w}]))"
    apart_bits = " + ".join(beyond("g.all", "g.any", w) for w in range(words))
    one_bits = " + ".join(beyond("p.bits", "p.bits", w) for w in range(words))
    apart = (
        side("g")
        .join(side("h"), "key")
        .where("g.c < h.c")
        .where(f"g.high * 100 >= h.low * {percent} and h.high * 100 >= g.low * {percent}")
        .where(f"least(g.left, h.left) >= ceil({percent} * (g.low + h.low) / {100 + percent})")
        .where(f"({apart_bits}) * {100 + percent} <= (g.high + h.high) * {100 - percent}")
        .select("key", F.col("g.c").alias("c1"), F.col("h.c").alias("c2"), "h")
        .join(member.select("key", F.col("c").alias("c1"), F.col("y").alias("p")), ["key", "c1"])
        .where(f"p.n * 100 >= h.low * {percent} and h.high * 100 >= p.n * {percent}")
        .where(f"({one_bits}) * {100 + percent} <= (p.n + h.high) * {100 - percent}")
        .drop("h")
        .join(member.select("key", F.col("c").alias("c2"), F.col("y").alias("q")), ["key", "c2"])
        .where(_can_link("p", "q", percent, words))
        .select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b"))
        .distinct()
        .join(stars, ["a", "b"], "left_anti")
    )
    return components(near.unionByName(stored(verified(stored(apart, "apart"), compared), "links")))
