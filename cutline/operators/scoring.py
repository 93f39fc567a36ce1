"""Standardised logistic fits by grouped Newton steps and an exact, distributed AUC."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from cutline.session import is_small

TRAIN = "train"
TEST = "test"
# Fixed value of the scoring rule: iteration limit.
MAX_ITERATIONS = 500
# A fit ends with a step this small beside its weights; what a Newton step leaves is about its square.
STEP = 1e-5


@dataclass(frozen=True)
class Scale:
    """Mean and population deviation of one feature over the training rows."""

    mean: float
    deviation: float

    def apply(self, value: Column) -> Column:
        return (value - F.lit(self.mean)) / F.lit(self.deviation)


@dataclass(frozen=True)
class Fit:
    """A fitted logistic model over standardised features."""

    features: tuple[str, ...]
    scales: tuple[Scale, ...]
    weights: tuple[float, ...]
    intercept: float
    positive: float = 1.0

    def probability(self) -> Column:
        margin = F.lit(self.intercept)
        for name, scale, weight in zip(self.features, self.scales, self.weights, strict=True):
            margin = margin + F.lit(weight) * scale.apply(F.col(name))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def _train_facts(frame: DataFrame, features: Sequence[str], *more: Column) -> tuple[Row, dict[str, Scale]]:
    """Training rows ``n``, the scale of every feature on them, and ``more`` over all rows, in one pass."""
    trained = F.col("split_name") == TRAIN
    row = frame.agg(
        F.count_if(trained).alias("n"),
        *[F.avg(F.when(trained, F.col(f))).alias(f"m_{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(F.when(trained, F.col(f))).alias(f"s_{i}") for i, f in enumerate(features)],
        *more,
    ).first()
    # A constant feature is only centred.
    return row, {f: Scale(row[f"m_{i}"], row[f"s_{i}"] or 1.0) for i, f in enumerate(features)}


def train_scales(frame: DataFrame, features: Sequence[str]) -> tuple[int, dict[str, Scale]]:
    """Training rows and the scale of every feature, in one pass."""
    row, scales = _train_facts(frame, features)
    return int(row["n"]), scales


def fit_models(frame: DataFrame, models: Mapping[str, Sequence[str]]) -> dict[str, Fit]:
    """Fit one model per name on the training rows; the number of models is configuration.

    Every model minimises the sum of logistic losses plus half the squared weights (the intercept is free).
    All models take their Newton steps together: one pass over the training rows yields the loss, gradient and
    Hessian sums of each, so the number of jobs depends on the steps needed and not on the models.
    """
    features = sorted({f for names in models.values() for f in names})
    # Any two labels: the larger one is the positive.
    facts, scales = _train_facts(frame, features, F.min("label").alias("low"), F.max("label").alias("high"))
    if not facts["n"]:
        raise ValueError("there are no training rows to fit on")
    single = facts["low"] == facts["high"]
    positive = 1.0 if single else float(facts["high"])
    if single:
        width = max((len(names) for names in models.values()), default=0)
        edge = math.inf if facts["low"] == positive else -math.inf
        found = {name: [edge] + [0.0] * width for name in models}
    else:
        found = _newton(frame.where(F.col("split_name") == TRAIN), models, scales, positive)
    return {
        name: Fit(tuple(names), tuple(scales[f] for f in names), tuple(found[name][1 : len(names) + 1]), found[name][0], positive)
        for name, names in models.items()
    }


def _newton(
    train: DataFrame, models: Mapping[str, Sequence[str]], scales: Mapping[str, Scale], positive: float
) -> dict[str, list[float]]:
    """Intercept and weights of every model; shorter models are filled with columns of zeros."""
    order = list(models)
    width = max(len(names) for names in models.values()) + 1
    rows = train.select(
        (F.col("label") == positive).cast("double").alias("_y"),
        F.inline(F.array(*[_inputs(number, models[name], scales, width) for number, name in enumerate(order)])),
    )
    sums = _newton_sums(width)
    point = {m: np.zeros(width) for m in range(len(order))}
    best: dict[int, tuple[float, np.ndarray]] = {}
    done: dict[int, np.ndarray] = {}
    margin = " + ".join(f"_w[{i}] * _x{i}" for i in range(width))
    for _ in range(MAX_ITERATIONS):
        # The weights fold into one literal, so every step runs the same compiled code.
        known = ", ".join(f"array({', '.join(f'{v!r}D' for v in point.get(m, np.zeros(width)).tolist())})" for m in range(len(order)))
        margins = rows.selectExpr("*", f"array({known})[_m] AS _w").selectExpr("*", f"{margin} AS _z")
        for row in margins.selectExpr("*", "1 / (1 + exp(-_z)) AS _p").groupBy("_m").agg(*sums).collect():
            if row["_m"] not in point:
                continue
            m, w = row["_m"], point[row["_m"]]
            loss = row["_loss"] + 0.5 * float(w[1:] @ w[1:])
            if m in best and loss > best[m][0] + 1e-12 * abs(best[m][0]):
                point[m] = (w + best[m][1]) / 2
                continue
            best[m] = (loss, w)
            free = np.append(0.0, np.ones(width - 1))
            gradient = np.array([row[f"_g{i}"] for i in range(width)]) + free * w
            hessian = np.array([[row[f"_h{min(i, j)}_{max(i, j)}"] for j in range(width)] for i in range(width)]) + np.diag(free)
            step = np.linalg.solve(hessian, gradient)
            point[m] = w - step
            if np.abs(step).max() <= STEP * max(1.0, np.abs(w).max()):
                done[m] = point.pop(m)
        if not point:
            break
    found = {m: w for m, (_, w) in best.items()} | done
    return {name: [float(v) for v in found[m]] for m, name in enumerate(order)}


def _inputs(number: int, names: Sequence[str], scales: Mapping[str, Scale], width: int) -> Column:
    values = [F.lit(1.0), *[scales[f].apply(F.col(f)).cast("double") for f in names]]
    values += [F.lit(0.0)] * (width - len(values))
    return F.struct(F.lit(number).alias("_m"), *[v.alias(f"_x{i}") for i, v in enumerate(values)])


def _newton_sums(width: int) -> list[Column]:
    """Loss, gradient and upper triangle of the Hessian of one model, from margin ``_z`` and chance ``_p``."""
    return [
        F.expr("sum(greatest(_z, 0) + log1p(exp(-abs(_z))) - _y * _z)").alias("_loss"),
        *[F.expr(f"sum((_p - _y) * _x{i})").alias(f"_g{i}") for i in range(width)],
        *[F.expr(f"sum(_p * (1 - _p) * _x{i} * _x{j})").alias(f"_h{i}_{j}") for i in range(width) for j in range(i, width)],
    ]


def scores(frame: DataFrame, fits: Mapping[str, Fit]) -> DataFrame:
    """Test rows scored by every model, as ``model, label, score``; label is 1 for the larger of the two codes."""
    pairs = F.array(
        *[
            F.struct(F.lit(name).alias("model"), fit.probability().alias("score"))
            for name, fit in fits.items()
        ]
    )
    test = frame.where(F.col("split_name") == TEST)
    positive = next((fit.positive for fit in fits.values()), 1.0)
    return test.select((F.col("label") == positive).cast("int").alias("label"), F.inline(pairs))


def exact_auc(
    scored: DataFrame, by: Sequence[str] = ("model",), label: str = "label", score: str = "score",
    small: bool | None = None,
) -> DataFrame:
    """AUC per group with ties counted half; NULL when a class is absent.

    Equal scores collapse first. The rest is range-partitioned by score; each part yields its
    own concordant pairs and class counts, so only one row per part meets in the last step.
    """
    by = list(by)
    is_positive = F.col(label) == 1
    collapsed = scored.groupBy(*by, score).agg(
        F.count_if(is_positive).alias("_pos"), F.count_if(~is_positive).alias("_neg")
    )
    if not (small if small is not None else is_small(collapsed)):
        parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        collapsed = collapsed.repartitionByRange(parts, *by, score)
        part = F.spark_partition_id()
    else:
        part = F.lit(0)
    inside = Window.partitionBy(*by, "_part").orderBy(score)
    lower = F.sum("_neg").over(inside) - F.col("_neg")
    chunks = (
        collapsed.withColumn("_part", part)
        .withColumn("_wins", F.col("_pos") * (lower + F.col("_neg") / 2))
        .groupBy(*by, "_part")
        .agg(
            F.sum("_wins").alias("_wins"), F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg")
        )
    )
    across = Window.partitionBy(*by).orderBy("_part")
    earlier = F.sum("_neg").over(across) - F.col("_neg")
    pairs = F.sum("_pos") * F.sum("_neg")
    return (
        chunks.withColumn("_earlier", earlier)
        .groupBy(*by)
        .agg(
            F.when(pairs > 0, F.sum(F.col("_wins") + F.col("_pos") * F.col("_earlier")) / pairs)
            .alias("auc"),
            F.sum("_pos").alias("positives"),
            F.sum("_neg").alias("negatives"),
        )
    )


def model_aucs(frame: DataFrame, fits: Mapping[str, Fit]) -> dict[str, float]:
    """Test AUC of every model, rounded to 6 places; one row per model reaches the driver."""
    rows = exact_auc(scores(frame, fits)).collect()
    return {row["model"]: round(float(row["auc"]), 6) for row in rows}
