"""Guard scan over a table of query texts: map-only, no join and no shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions import guard


def read_queries(
    corpus: DataFrame, available: str, prediction: str, targets: Sequence[str] = ()
) -> DataFrame:
    """Reduce each text once; every nominated table is then judged on the same columns.

    With ``targets``, a text that never contains the name of one, nor a macro that could give it, is
    not read for tables and guards: most of a corpus, as a rule.
    """
    macro = F.col("sql").contains("{{")
    names = [macro | F.lower("sql").contains(guard.last_part(target)) for target in targets]
    touched = reduce(or_, names) if names else F.lit(True)

    def when_touched(value: Column) -> Column:
        return F.when(F.col("_touched"), value)

    nothing = F.array().cast("array<string>")
    no_table = F.array().cast("array<struct<name:string,alias:string>>")
    return (
        corpus.withColumn("_touched", touched)
        .withColumn("_plain", guard.plain_sql(guard.resolve_templating(F.col("sql"))))
        .withColumn(
            "_references",
            F.coalesce(when_touched(guard.table_references(F.col("_plain"))), no_table),
        )
        .withColumn("_clauses", when_touched(guard.clauses(F.col("_plain"), available, prediction)))
        .withColumn(
            "cutoff_predicates",
            F.coalesce(guard.cutoff_predicates(F.col("_clauses"), available, prediction), nothing),
        )
        .withColumn("_guarded", guard.guarded_aliases(F.col("cutoff_predicates"), available))
        .drop("_clauses", "_touched")
    )


def tables_read() -> Column:
    """Sorted names of the tables a statement reads; prose that is no statement reads none."""
    named = guard.referenced_tables(F.col("_references"))
    return F.when(guard.is_statement(F.col("_plain")), named).otherwise(F.array().cast("array<string>"))


def verify_queries(
    corpus: DataFrame,
    post_outcome_table: str,
    available: str = "available_at",
    prediction: str = "prediction_time",
) -> DataFrame:
    """Status, reason, referenced tables and guards of every text for one nominated table."""
    plain = F.col("_plain")
    status = guard.guard_status(plain, F.col("_references"), F.col("_guarded"), post_outcome_table)
    status = F.coalesce(status, F.lit(guard.INDETERMINATE))
    judged = read_queries(corpus, available, prediction).withColumn("status", status)
    return judged.select(
        *corpus.columns,
        "status",
        guard.guard_reason(F.col("status"), plain, available, prediction).alias("reason"),
        tables_read().alias("referenced_tables"),
        "cutoff_predicates",
        F.coalesce(
            guard.weak_guard(plain, F.col("cutoff_predicates"), prediction), F.lit(False)
        ).alias("weak_guard"),
        guard.guard_exit_code(F.col("status")).alias("exit_code"),
    )


def scan_corpus(
    corpus: DataFrame,
    post_outcome_tables: Sequence[str],
    available: str = "available_at",
    prediction: str = "prediction_time",
) -> DataFrame:
    """Worst status of every text over all nominated tables, the table that decided it, and why.

    Tables and predicates are read from texts that may name a nominated table; others report none.
    """
    if not post_outcome_tables:
        raise ValueError("at least one post-outcome table is required")
    plain, references, guarded = F.col("_plain"), F.col("_references"), F.col("_guarded")
    judged = read_queries(corpus, available, prediction, post_outcome_tables)
    names = [f"_status_{i}" for i in range(len(post_outcome_tables))]
    judged = judged.withColumns(
        {
            name: F.coalesce(
                guard.guard_status(plain, references, guarded, table), F.lit(guard.INDETERMINATE)
            )
            for name, table in zip(names, post_outcome_tables, strict=True)
        }
    )
    worst = guard.worst_status([F.col(n) for n in names])
    decided = F.coalesce(
        *[F.when(F.col(name) == worst, F.lit(table)) for name, table in zip(names, post_outcome_tables, strict=True)]
    )
    return judged.withColumn("status", worst).select(
        *corpus.columns,
        "status",
        F.when(F.col("status") == guard.VIOLATION, decided).alias("post_outcome_table"),
        guard.guard_reason(F.col("status"), plain, available, prediction).alias("reason"),
        tables_read().alias("referenced_tables"),
        "cutoff_predicates",
        F.coalesce(
            guard.weak_guard(plain, F.col("cutoff_predicates"), prediction), F.lit(False)
        ).alias("weak_guard"),
    )


def scan_summary(scanned: DataFrame) -> DataFrame:
    """Counts by status and the exit code of the whole scan; nothing scanned is no pass."""
    status = F.col("status")
    counts = scanned.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(status == guard.VIOLATION).alias("violations"),
        F.count_if(status == guard.SAFE).alias("safe"),
        F.count_if(status == guard.INDETERMINATE).alias("unparseable"),
        F.count_if(status == guard.NOT_APPLICABLE).alias("not_applicable"),
    )
    unknown = (F.col("unparseable") > 0) | (F.col("scanned") == 0)
    return counts.withColumn(
        "exit_code", F.when(F.col("violations") > 0, 3).when(unknown, 2).otherwise(0)
    )
