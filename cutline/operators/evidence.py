"""The evidence store: approval-gated publication that is re-read after every write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutline.session import settle

# The kinds of evidence one publication writes, and the tag it sets.
PLANNED_TYPES = ("field_tag", "structured_property", "audit_document", "active_incident")
CONFIRMED_TAG = "leakage-confirmed"
CANDIDATE_TAG = "leakage-candidate"

# Key and stored columns of each evidence table. Documents have versions: a row is never rewritten, and the
# largest version of a key is the one that holds.
TABLES = {
    "tags": ["target_urn", "field", "tag"],
    "properties": ["target_urn", "property", "value"],
    "documents": ["document_id", "target_urn", "title", "config_sha256", "observed_auc",
                  "point_in_time_auc", "excluded_records", "safe_delta", "safe_retained",
                  "content_sha256", "version"],
    "incidents": ["target_urn", "title", "incident_id", "state", "document_id"],
}
KEYS = {
    "tags": ["target_urn", "field", "tag"],
    "properties": ["target_urn", "property", "value"],
    "documents": ["document_id", "target_urn"],
    "incidents": ["target_urn", "title"],
}
VERDICT_PROPERTY = "audit_verdict"

BUNDLES = (
    "case_id string, target_urn string, bound_urn string, field string, field_known boolean, "
    "verdict string, release_decision string, config_sha256 string, observed_auc double, "
    "point_in_time_auc double, excluded_records bigint, safe_delta double, safe_retained double"
)


def document_id(case_id: Column) -> Column:
    plain = F.regexp_replace(case_id, r"[^a-zA-Z0-9_-]+", "-")
    return F.concat(F.lit("audit-"), F.regexp_replace(plain, r"^-+|-+$", ""))


def incident_title(case_id: Column) -> Column:
    return F.concat(F.lit("Release blocked: "), case_id)


def incident_id(target: Column, title: Column) -> Column:
    return F.concat(F.lit("incident-"), F.sha2(F.concat_ws("\u0001", target, title), 256))


def refusal(target_urn: Column, bound_urn: Column) -> Column:
    """Why a bundle must not be written to a target; NULL when it may be."""
    return (
        F.when(
            (F.col("release_decision") != "block") | (F.col("verdict") != "confirmed")
            | F.col("release_decision").isNull() | F.col("verdict").isNull(),
            F.lit("only a confirmed bundle that blocks can be published"),
        )
        .when(
            target_urn.isNull() | ~target_urn.startswith("urn:li:dataset:"),
            F.lit("publication needs a dataset target"),
        )
        .when(bound_urn.isNull(), F.lit("the evidence is not bound to an exact target"))
        .when(bound_urn != target_urn, F.lit("the evidence is bound to another target"))
        .when(
            ~F.coalesce("field_known", F.lit(False)),
            F.lit("the target lacks schema metadata for the field"),
        )
    )


def publish_plan(bundles: DataFrame) -> DataFrame:
    """What a publication would write; nothing is written."""
    return bundles.select(
        "case_id",
        "target_urn",
        F.lit("awaiting_human_approval").alias("status"),
        F.array(*[F.lit(t) for t in PLANNED_TYPES]).alias("planned_types"),
        F.lit(False).alias("mutation_performed"),
    )


def evidence_rows(bundles: DataFrame) -> dict[str, DataFrame]:
    """The rows each evidence table needs for the given bundles."""
    case, target = F.col("case_id"), F.col("target_urn")
    title = incident_title(case)
    rows = {
        "tags": bundles.select(target, "field", F.lit(CONFIRMED_TAG).alias("tag")),
        "properties": bundles.select(
            target, F.lit(VERDICT_PROPERTY).alias("property"), F.col("verdict").alias("value")
        ),
        "documents": bundles.select(
            document_id(case).alias("document_id"),
            target,
            F.concat(F.lit("Audit: "), case).alias("title"),
            *TABLES["documents"][3:-2],
            content_sha256().alias("content_sha256"),
        ),
        "incidents": bundles.select(
            target,
            title.alias("title"),
            incident_id(target, title).alias("incident_id"),
            F.lit("ACTIVE").alias("state"),
            document_id(case).alias("document_id"),
        ),
    }
    # Bundles that disagree on one document: the largest content holds, whatever the order of rows.
    told = [c for c in rows["documents"].columns if c not in KEYS["documents"]]
    first = ["content_sha256", *[c for c in told if c != "content_sha256"]]
    rows["documents"] = (
        rows["documents"].groupBy(*KEYS["documents"]).agg(F.max(F.struct(*first)).alias("_held"))
        .select(*KEYS["documents"], *[F.col(f"_held.{c}") for c in told])
    )
    return {name: frame if name == "documents" else frame.dropDuplicates(KEYS[name]) for name, frame in rows.items()}


def content_sha256() -> Column:
    """Hash of what a bundle says, so that a re-read can tell these numbers from earlier ones."""
    return F.sha2(F.to_json(F.struct("case_id", *TABLES["documents"][3:-2]), {"ignoreNullFields": "false"}), 256)


def stored(spark: SparkSession, store: str, table: str, like: DataFrame) -> DataFrame:
    """An evidence table as it is on disk; empty before its first write."""
    path = f"{store}/{table}"
    if not _exists(spark, path):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(path)


def upsert(rows: DataFrame, store: str, table: str) -> DataFrame:
    """Append the rows whose key the table lacks, and return the table re-read.

    Existing rows win, so a repeated publication reuses them. One writer per store.
    """
    spark = rows.sparkSession
    keys = KEYS[table]
    wanted = settle(rows)
    held = stored(spark, store, table, wanted)
    # Only the keys at hand are looked for in the table, so the table is never shuffled whole.
    seen = held.select(*keys).join(wanted.select(*keys), keys, "left_semi")
    fresh = wanted.join(seen, keys, "left_anti")
    fresh.write.mode("append").parquet(f"{store}/{table}")
    return stored(spark, store, table, wanted)


def append_versions(rows: DataFrame, store: str, table: str = "documents") -> DataFrame:
    """Append the rows whose content differs from the latest version of their key; returns the latest versions.

    What was stored stays, with its version number. One writer per store.
    """
    keys = KEYS[table]
    wanted = settle(rows)
    shape = wanted.withColumn("version", F.lit(1).cast("bigint")).select(*TABLES[table])
    held = stored(rows.sparkSession, store, table, shape).join(wanted.select(*keys), keys, "left_semi")
    latest = held.groupBy(*keys).agg(
        F.max_by("content_sha256", "version").alias("_content"), F.max("version").alias("_version")
    )
    fresh = (
        wanted.join(latest, keys, "left").where(~F.col("content_sha256").eqNullSafe(F.col("_content")))
        .withColumn("version", F.coalesce("_version", F.lit(0)).cast("bigint") + 1)
    )
    fresh.select(*TABLES[table]).write.mode("append").parquet(f"{store}/{table}")
    return latest_versions(stored(rows.sparkSession, store, table, shape).join(wanted.select(*keys), keys, "left_semi"), table)


def latest_versions(rows: DataFrame, table: str = "documents") -> DataFrame:
    """The version that holds, of every key."""
    keys = KEYS[table]
    rest = [c for c in TABLES[table] if c not in keys and c != "version"]
    return rows.groupBy(*keys).agg(F.max(F.struct("version", *rest)).alias("_held")).select(
        *keys, *[F.col(f"_held.{c}").alias(c) for c in [*rest, "version"]]
    )


def publish(bundles: DataFrame, store: str, approved: bool = False) -> DataFrame:
    """Publish confirmed bundles, then report what a re-read of the store says.

    Without ``approved`` only the plan is returned. Refused bundles keep their reason and
    write nothing. ``published`` needs all four kinds of evidence to be found again.
    """
    if not approved:
        return publish_plan(bundles)
    judged = settle(
        bundles.withColumn("refusal", refusal(F.col("target_urn"), F.col("bound_urn")))
    )
    accepted = judged.where(F.col("refusal").isNull())
    result = judged.select(
        "case_id", "target_urn", "verdict", "release_decision", "refusal", "field", content_sha256().alias("content_sha256")
    )
    result = result.withColumn("document_id", document_id(F.col("case_id"))).withColumn(
        "title", incident_title(F.col("case_id"))
    )
    checks = {
        "tags": "confirmed_field_tag_reread",
        "properties": "confirmed_structured_property_reread",
        "documents": "audit_document_reread",
        "incidents": "active_incident_reread",
    }
    for table, rows in evidence_rows(accepted).items():
        reread = append_versions(rows, store) if table == "documents" else upsert(rows, store, table)
        if table == "tags":
            reread, on = reread.where(F.col("tag") == CONFIRMED_TAG), ["target_urn", "field"]
        elif table == "properties":
            expected = (F.col("property") == VERDICT_PROPERTY) & (F.col("value") == "confirmed")
            reread, on = reread.where(expected), ["target_urn"]
        elif table == "documents":
            # Another version of the document does not prove that this one was stored.
            on = ["document_id", "target_urn", "content_sha256"]
        else:
            reread, on = reread.where(F.col("state") == "ACTIVE"), ["target_urn", "title"]
        # Only this publication's keys are looked for, however large the store has grown.
        asked = result.select(*on).distinct()
        found = (
            reread.select(*on)
            .join(asked, on, "left_semi")
            .distinct()
            .withColumn(checks[table], F.lit(True))
        )
        result = result.join(found, on, "left").withColumn(
            checks[table],
            F.when(F.col("refusal").isNull(), F.coalesce(checks[table], F.lit(False))),
        )
    every = F.lit(True)
    for name in checks.values():
        every = every & F.col(name)
    status = (
        F.when(F.col("refusal").isNotNull(), F.lit("refused"))
        .when(every, F.lit("published"))
        .otherwise(F.lit("verification_failed"))
    )
    return result.select(
        "case_id",
        "target_urn",
        "verdict",
        "release_decision",
        status.alias("status"),
        "refusal",
        *checks.values(),
        F.when(F.col("refusal").isNull(), F.col("document_id")).alias("document_id"),
        F.when(
            F.col("refusal").isNull(), incident_id(F.col("target_urn"), F.col("title"))
        ).alias("incident_id"),
        F.col("refusal").isNull().alias("mutation_performed"),
    )


def raise_incidents(blocked: DataFrame, store: str) -> DataFrame:
    """Raise, or reuse, one incident per (target, case): a notice, never an approval."""
    title = incident_title(F.col("case_id"))
    rows = blocked.select(
        "target_urn",
        title.alias("title"),
        incident_id(F.col("target_urn"), title).alias("incident_id"),
        F.lit("ACTIVE").alias("state"),
        F.lit("(raised by the release gate)").alias("document_id"),
    ).dropDuplicates(KEYS["incidents"])
    return upsert(rows, store, "incidents")


def bound_evidence(evidence: DataFrame, bindings: DataFrame) -> DataFrame:
    """Evidence rows with the reason they may not reach their asset; NULL when they may.

    ``bindings`` maps an audit to the one URN its evidence may be written to.
    """
    joined = evidence.join(bindings.select("audit", F.col("target_urn").alias("bound_urn")), "audit", "left")
    reason = F.when(
        F.col("bound_urn").isNull(), F.lit("the evidence is not bound to an exact target")
    ).when(F.col("bound_urn") != F.col("target_urn"), F.lit("the evidence is bound to another target"))
    return joined.withColumn("reason", reason)


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.parquet(path).schema
    except AnalysisException:
        return False
    return True
