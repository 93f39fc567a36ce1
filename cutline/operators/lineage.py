"""Directed column paths over an edge table, by frontier joins."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.session import settle, shuffles_freed, stored

# Walks end when no new node is met; a caller may bound them.
MAX_HOPS = None
#: Sources for each target from which on walks start at the targets: the sources then share all but their first step.
SHARED = 8


def _hops(first: int, most: int | None):
    return count(first) if most is None else range(first, most + 1)


def column_path(
    edges: DataFrame, pairs: DataFrame, max_hops: int | None = MAX_HOPS, with_queries: bool = False
) -> DataFrame:
    """The shortest downstream path of every ``(source, target)`` pair; ties by node text.

    Returns ``source, target, available, found, hops, path``, hops being nodes - 1. With no
    edges at all the catalog could not be asked, which is not the same as an answer of "no
    path". ``with_queries`` also lists the query an edge came through, between its columns.
    """
    pairs = pairs.select("source", "target")
    via = F.col("via") if with_queries else F.lit(None).cast("string").alias("via")
    steps = edges.dropna(subset=["src_node", "dst_node"]).select("src_node", "dst_node", via)
    ends = pairs.agg(F.approx_count_distinct("source").alias("sources"), F.approx_count_distinct("target").alias("targets")).first()
    if ends["sources"] >= SHARED * ends["targets"] > 0 and (max_hops is None or max_hops > 0):
        with shuffles_freed(pairs.sparkSession):
            return _from_targets(steps, pairs, max_hops)
    return _from_sources(steps, pairs, max_hops)


def _step_before(path: str):
    """A path with the query, if known, of the step that leads to it."""
    return F.when(F.col("via").isNotNull(), F.concat(F.array("via"), path)).otherwise(F.col(path))


def _from_sources(steps: DataFrame, pairs: DataFrame, max_hops: int | None) -> DataFrame:
    pairs = settle(pairs.distinct())
    steps = settle(steps.distinct())
    target = F.array("dst_node")
    step = F.when(F.col("via").isNotNull(), F.concat(F.array("via"), target)).otherwise(target)
    asked = not steps.isEmpty()
    # Walks stay on nodes that lead to some target, however far a source fans out.
    targets = pairs.select(F.col("target").alias("node")).distinct()
    leading = targets.unionByName(_reached(steps, targets, "dst_node", "src_node", max_hops))
    steps = settle(
        steps.join(leading.withColumnRenamed("node", "dst_node"), "dst_node", "left_semi")
    )
    # One walk per source serves all its targets; a source whose targets are found stops.
    open_pairs = pairs
    frontier = pairs.select("source").distinct().select(
        "source", F.col("source").alias("node"), F.array("source").alias("path")
    )
    walked: list[DataFrame] = []
    nowhere = open_pairs.limit(0).withColumn("path", F.lit(None).cast("array<string>"))
    answers: list[DataFrame] = [nowhere]
    for hop in _hops(0, max_hops):
        frontier = settle(frontier)
        if frontier.isEmpty():
            break
        walked.append(frontier.select("source", "node"))
        arrived = frontier.withColumnRenamed("node", "target")
        met = settle(open_pairs.join(arrived, ["source", "target"], "left"))
        answers.append(met.where(F.col("path").isNotNull()))
        open_pairs = met.where(F.col("path").isNull()).drop("path")
        counts = met.agg(F.count("path").alias("met"), F.count(F.lit(1)).alias("all")).first()
        if hop == max_hops or counts["met"] == counts["all"]:
            break
        if counts["met"] > 0:
            waiting = open_pairs.select("source").distinct()
            frontier = frontier.join(waiting, "source", "left_semi")
        # Several ways to one node collapse before they are shuffled; the smallest text wins.
        frontier = (
            frontier.join(steps, F.col("node") == F.col("src_node"))
            .groupBy("source", F.col("dst_node").alias("node"))
            .agg(F.min(F.concat("path", step)).alias("path"))
            .join(reduce(DataFrame.unionByName, walked), ["source", "node"], "left_anti")
        )
    found = reduce(DataFrame.unionByName, answers)
    return _answers(pairs.join(found, ["source", "target"], "left"), asked)


def _from_targets(steps: DataFrame, pairs: DataFrame, max_hops: int | None) -> DataFrame:
    """Walks from each target back over the nodes that some source leads to; each pair then takes its first step.

    No row of a walk belongs to a source, so their number follows the nodes between and not the pairs. Tables are
    written, and shuffle files go with each, so what a walk leaves on disk is its nodes once.
    """
    asked = not steps.isEmpty()
    entered = steps.select(F.col("dst_node").alias("src_node")).distinct()
    sources = pairs.select(F.col("source").alias("src_node"))
    targets = pairs.select("target").where("target is not null").distinct()
    # One exchange serves the distinct rows and the join by the same column.
    steps = steps.repartition("src_node").distinct()
    pairs = pairs.repartition("source").distinct()
    inner = stored(steps.join(entered, "src_node", "left_semi"), "inner-steps")
    first = stored(steps.join(sources, "src_node", "left_semi").select(F.col("dst_node").alias("node")).distinct(), "first-nodes")
    between = [first, _reached(inner, first, "src_node", "dst_node", None if max_hops is None else max_hops - 1, stored)]
    between = reduce(DataFrame.unionByName, between).withColumnRenamed("node", "src_node")
    inner = stored(inner.join(between, "src_node", "left_semi"), "inner-steps")
    frontier = targets.select("target", F.col("target").alias("node"), F.array("target").alias("path"))
    walked: list[DataFrame] = []
    for hop in _hops(0, None if max_hops is None else max_hops - 1):
        if hop:
            # Several ways from one node collapse before they are shuffled; the smallest text wins.
            frontier = (
                walked[-1].drop("hops")
                .join(inner, F.col("node") == F.col("dst_node"))
                .groupBy("target", F.col("src_node").alias("node"))
                .agg(F.min(F.concat(F.array("src_node"), _step_before("path"))).alias("path"))
                .join(reduce(DataFrame.unionByName, walked).select("target", "node"), ["target", "node"], "left_anti")
            )
        frontier = stored(frontier.withColumn("hops", F.lit(hop)), "walked")
        if frontier.isEmpty():
            break
        walked.append(frontier)
    before = reduce(DataFrame.unionByName, walked).withColumnRenamed("node", "dst_node")
    way = F.when(F.col("path").isNotNull(), F.struct("hops", _step_before("path").alias("path")))
    answered = (
        pairs.join(steps, F.col("source") == F.col("src_node"), "left")
        .join(before, ["target", "dst_node"], "left")
        .groupBy("source", "target")
        .agg(F.min(way).alias("way"))
    )
    own = F.array("source")
    return _answers(
        answered.select("source", "target", F.when(F.col("source") == F.col("target"), own).otherwise(F.concat(own, "way.path")).alias("path")),
        asked,
    )


def _answers(answered: DataFrame, asked: bool) -> DataFrame:
    return answered.select(
        "source",
        "target",
        F.lit(asked).alias("available"),
        (F.lit(asked) & F.col("path").isNotNull()).alias("found"),
        F.greatest(F.coalesce(F.size("path"), F.lit(0)) - 1, F.lit(0)).alias("hops"),
        F.coalesce("path", F.array().cast("array<string>")).alias("path"),
    )


def _reached(
    steps: DataFrame, start: DataFrame, leave: str, arrive: str, max_hops: int | None, keep=None
) -> DataFrame:
    """The set of nodes one to ``max_hops`` steps away from any start node, settled hop by hop unless ``keep`` says how."""
    reached: list[DataFrame] = [] if max_hops != 0 else [start.limit(0)]
    frontier = start
    for _ in _hops(1, max_hops):
        frontier = (
            steps.join(frontier, F.col(leave) == F.col("node"), "left_semi")
            .select(F.col(arrive).alias("node"))
            .distinct()
        )
        if reached:
            frontier = frontier.join(reduce(DataFrame.unionByName, reached), "node", "left_anti")
        frontier = settle(frontier) if keep is None else keep(frontier, "reached")
        reached.append(frontier)
        if frontier.isEmpty():
            break
    return reduce(DataFrame.unionByName, reached)


def upstream(edges: DataFrame, nodes: DataFrame, max_hops: int | None = MAX_HOPS) -> DataFrame:
    """Every ancestor of the given nodes within ``max_hops``: ``node, ancestor, hops``."""
    steps = settle(edges.select("src_node", "dst_node").dropna().distinct())
    start = nodes.select("node").distinct()
    closure = settle(start.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("hops")))
    frontier = closure
    for hop in _hops(1, max_hops):
        frontier = settle(
            frontier.select("node", "ancestor")
            .join(steps, F.col("ancestor") == F.col("dst_node"))
            .select("node", F.col("src_node").alias("ancestor"))
            .distinct()
            .join(closure.select("node", "ancestor"), ["node", "ancestor"], "left_anti")
            .withColumn("hops", F.lit(hop))
        )
        if frontier.isEmpty():
            break
        closure = settle(closure.unionByName(frontier))
    return closure.where(F.col("hops") > 0)


def suspicious_ancestry(
    edges: DataFrame, features: DataFrame, outcomes: DataFrame, max_hops: int | None = MAX_HOPS
) -> DataFrame:
    """Features that share an ancestor with an outcome column but do not descend from one.

    Only sets of nodes are walked: up from the outcomes, down from their ancestors, and down
    from the outcomes. Features, ancestors and outcomes never pair up.
    """
    steps = settle(edges.select("src_node", "dst_node").dropna().distinct())
    start = outcomes.select("node").distinct()
    ancestors = _reached(steps, start, "dst_node", "src_node", max_hops)
    related = _reached(steps, ancestors, "src_node", "dst_node", max_hops)
    derived = _reached(steps, start, "src_node", "dst_node", max_hops)
    return (
        features.select("node")
        .distinct()
        .join(related.withColumn("_related", F.lit(True)), "node", "left")
        .join(derived.withColumn("_derived", F.lit(True)), "node", "left")
        .select(
            "node",
            (F.col("_related").isNotNull() & F.col("_derived").isNull()).alias(
                "suspicious_common_ancestry"
            ),
        )
    )


def path_nodes(paths: DataFrame, late: str = "late", model: str | None = None) -> DataFrame:
    """A path as ordered rows: source first, features, model last; the first hop can violate."""
    keep = [c for c in paths.columns if c not in ("path", late, model)]
    steps = F.transform(
        F.col("path"),
        lambda node, i: F.struct(
            node.alias("node"),
            F.when(i == 0, F.lit("source")).otherwise(F.lit("feature")).alias("kind"),
            ((i == 0) & F.col(late)).alias("violates"),
        ),
    )
    if model is not None:
        last = F.struct(
            F.col(model).alias("node"), F.lit("model").alias("kind"), F.lit(False).alias("violates")
        )
        has_model = F.col(model).isNotNull() & (F.col(model) != "") & (F.size("path") > 0)
        steps = F.when(has_model, F.concat(steps, F.array(last))).otherwise(steps)
    numbered = paths.select(*keep, F.posexplode(steps).alias("position", "step"))
    node = F.col("step.node")
    return numbered.select(
        *keep,
        "position",
        # A node is cut at its first dot: the column may itself be nested.
        F.substring_index(node, ".", 1).alias("table"),
        F.when(
            (F.col("step.kind") != "model") & node.contains("."), F.regexp_extract(node, r"^[^.]*\.(.*)$", 1)
        ).otherwise(F.lit("")).alias("column"),
        F.col("step.kind").alias("kind"),
        F.col("step.violates").alias("violates"),
    )
