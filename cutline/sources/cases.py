"""Audit cases and lineage exports as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = (
    "case_id string, model_urn string, feature_urn string, lineage_path array<string>, "
    "source_kind string, source_available_at string, prediction_time string, "
    "metadata_complete boolean, suspicious_common_ancestry boolean, "
    "deterministic_cutoff_proof boolean, point_in_time_advantage_collapsed boolean, "
    "ablation_delta double, notes array<string>"
)
EDGES = "src_node string, dst_node string, via string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """One case per JSON document; times with a ``Z`` or offset are read in UTC."""
    return typed_cases(spark.read.schema(CASES).json(path, multiLine=True))


def typed_cases(raw: DataFrame) -> DataFrame:
    return raw.withColumns(
        {
            "source_available_at": F.col("source_available_at").try_cast("timestamp"),
            "prediction_time": F.col("prediction_time").try_cast("timestamp"),
            "metadata_complete": F.coalesce("metadata_complete", F.lit(True)),
            **{
                name: F.coalesce(name, F.lit(False))
                for name in (
                    "suspicious_common_ancestry",
                    "deterministic_cutoff_proof",
                    "point_in_time_advantage_collapsed",
                )
            },
        }
    )


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EDGES).parquet(path)


_HOPS = "array<struct<column string, fieldPath string, urn string, name string, entity string>>"
# Fixed names a catalog response may use for the paths and for the hops in one path.
_PATH_FIELDS = ("paths", "lineage_paths", "results")
_HOP_FIELDS = ("path", "hops", "entities")


def path_from_response(response: Column) -> Column:
    """The hop labels of the first path of a catalog response, whatever its shape.

    A response may list paths as arrays of names, arrays of objects, or objects that hold
    such an array; an unknown shape gives an empty path rather than a guess.
    """

    def labels(json_array: Column) -> Column:
        objects = F.transform(
            F.from_json(json_array, _HOPS),
            lambda hop: F.coalesce(
                hop["column"], hop["fieldPath"], hop["urn"], hop["name"], hop["entity"]
            ),
        )
        named = F.when(F.size(objects) > 0, F.when(F.forall(objects, F.isnotnull), objects))
        plain = F.from_json(json_array, "array<string>")
        return F.when(json_array.startswith("["), F.coalesce(named, plain))

    candidates = []
    for outer in _PATH_FIELDS:
        candidates.append(labels(F.get_json_object(response, f"$.{outer}[0]")))
        for inner in _HOP_FIELDS:
            candidates.append(labels(F.get_json_object(response, f"$.{outer}[0].{inner}")))
    return F.coalesce(*candidates, F.array().cast("array<string>"))
