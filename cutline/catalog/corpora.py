"""Guard scans over a corpus of query texts as large as the documents table.

Each document becomes one query text: a statement of a known kind around the whole document,
which sits in a comment or a string literal that the scan has to see through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutline.catalog.registry import register, table
from cutline.functions import guard
from cutline.operators.corpus import scan_corpus, scan_summary, verify_queries
from cutline.session import fresh_path

PAYMENTS = "raw.payments_after"
DISPUTES = "disputes_after"

# (statement with @ for the hidden document, status for payments, status over both tables,
#  weak guard, referenced tables)
KINDS = (
    (
        "/*@*/ select a.id, max(p.ts) from apps as a left join payments_after as p on p.k = a.k group by a.id",
        "violation", "violation", False, "apps,payments_after",
    ),
    (
        "select a.id from apps a /*@*/ left join raw.payments_after p on p.k = a.k"
        " and p.available_at <= a.prediction_time",
        "safe", "safe", False, "apps,raw.payments_after",
    ),
    (
        "select a.id, '@' as note from apps a join prod.raw.payments_after p on a.prediction_time >= p.available_at",
        "safe", "safe", False, "apps,prod.raw.payments_after",
    ),
    (
        "select 1 from payments_after p join apps a using (k) join log l using (k)"
        " where l.available_at <= a.prediction_time -- @",
        "violation", "violation", False, "apps,log,payments_after",
    ),
    (
        "/* join payments_after p @*/ select id from apps",
        "not_applicable", "not_applicable", False, "apps",
    ),
    (
        "select a.id from apps a join disputes_after d on d.k = a.k where '@' <> ''",
        "not_applicable", "violation", False, "apps,disputes_after",
    ),
    (
        "{{ config(materialized='table') }} {# @ #} select a.id from {{ ref('apps') }} as a"
        " left join {{ source('raw', 'payments_after') }} as p on p.k = a.k",
        "violation", "violation", False, "apps,raw.payments_after",
    ),
    (
        "{% set x = 1 %} select a.id from {{ ref('apps') }} as a left join {{ ref('shop', 'payments_after') }} as p"
        " on p.k = a.k and coalesce(p.available_at, p.ts) <= a.prediction_time /*@*/",
        "safe", "safe", False, "apps,payments_after",
    ),
    ("@", "indeterminate", "indeterminate", False, ""),
    (
        "select a.id from apps a, payments_after p where p.available_at between a.start and a.prediction_time /*@*/",
        "violation", "violation", False, "apps,payments_after",
    ),
    (
        "select 1 from apps a join payments_after p1 on p1.available_at <= a.prediction_time"
        " join payments_after p2 on p2.k = a.k /*@*/",
        "violation", "violation", False, "apps,payments_after",
    ),
    (
        "select 1 from apps a join payments_after p on p.available_at <= a.cutoff and a.prediction_time > p.ts /*@*/",
        "violation", "violation", False, "apps,payments_after",
    ),
    (
        "select 1 /*@*/ from apps a join payments_after p on p.available_at <= a.prediction_time or p.k = 1",
        "safe", "safe", True, "apps,payments_after",
    ),
    (
        'select 1 /*@*/ from "apps" as "a" join "raw"."payments_after" as "p"'
        ' on "p"."available_at" <= "a"."prediction_time" + interval \'3\' day',
        "safe", "safe", True, "apps,raw.payments_after",
    ),
    (
        "select 1 from apps a join payments_after p on (p.k = a.k /*@*/",
        "indeterminate", "indeterminate", False, "apps,payments_after",
    ),
    (
        "with late as (select * from disputes_after d join apps a on d.available_at < a.prediction_time)"
        " select * from late /*@*/",
        "not_applicable", "safe", False, "apps,disputes_after,late",
    ),
    (
        "select p.available_at <= a.prediction_time as ok, p.v, '@' from apps a join payments_after p on a.id = p.id",
        "violation", "violation", False, "apps,payments_after",
    ),
    (
        "select 1 /*@*/ from apps a join payments_after p on"
        " f1(f2(f3(f4(f5(f6(f7(f8(p.available_at, 1), 2), 3), 4), 5), 6), 7), 8) <= ((((((((a.prediction_time))))))))",
        "safe", "safe", False, "apps,payments_after",
    ),
    (
        "select (select 1 from b where b.k = 1), p.available_at <= a.prediction_time from apps a"
        " join payments_after p on p.k = a.k /*@*/",
        "violation", "violation", False, "apps,b,payments_after",
    ),
    (
        "select E'\\'--', p.v from apps a join payments_after p on p.k = a.k /*@*/",
        "violation", "violation", False, "apps,payments_after",
    ),
    (
        "select '\\'--', p.v from apps a join payments_after p on p.available_at <= a.prediction_time /*@*/",
        "indeterminate", "indeterminate", False, "",
    ),
    (
        "select 1 /*@*/ from apps a join payments_after p on p.k = a.k # and p.available_at <= a.prediction_time",
        "indeterminate", "indeterminate", False, "",
    ),
    (
        "select 1 from apps a join payments_after p on p.k in (select k from b where b.v = 1 /*@*/)"
        " and p.available_at <= a.prediction_time",
        "safe", "safe", False, "apps,b,payments_after",
    ),
)


def query_texts(spark, folder) -> DataFrame:
    """``doc_id, path, sql`` with one text per document."""
    documents = table(spark, folder, "documents")
    # What would end the comment, literal or template around the document is taken out.
    hidden = F.regexp_replace("text", r"\*/|['{}#%]|\r|\n", " ")
    kind = F.pmod("doc_id", F.lit(len(KINDS)))
    sql = F.coalesce(
        *[
            F.when(kind == i, F.replace(F.lit(statement), F.lit("@"), hidden))
            for i, (statement, *_) in enumerate(KINDS)
        ]
    )
    return documents.select(
        "doc_id", F.concat(F.lit("models/m_"), "doc_id", F.lit(".sql")).alias("path"), sql.alias("sql")
    )


def _case(values) -> str:
    def text(value) -> str:
        if value is None:
            return "NULL"
        return str(value) if isinstance(value, bool) else f"'{value}'"

    whens = " ".join(f"WHEN {i} THEN {text(v)}" for i, v in enumerate(values))
    return f"CASE doc_id % {len(KINDS)} {whens} END"


_ONE = _case([k[1] for k in KINDS])
_BOTH = _case([k[2] for k in KINDS])
_WEAK = _case([k[3] for k in KINDS])
_TABLES = _case([k[4] for k in KINDS])
_REASONS = {
    "indeterminate": "The text could not be read as a query.",
    "not_applicable": "The post-outcome source is not read by this query.",
    "safe": "An availability cutoff protects the post-outcome source.",
    "violation": "The post-outcome source is read, but no available_at <= prediction_time cutoff holds.",
}
_WHY = _case(
    [
        _REASONS[k[2]] + (" available_at is never mentioned." if k[2] == "violation" and "available_at" not in k[0] else "")
        for k in KINDS
    ]
)


@register(
    "guard_status",
    f"""SELECT doc_id, {_ONE} AS status, {_WEAK} AS weak_guard,
  CASE {_ONE} WHEN 'violation' THEN 3 WHEN 'indeterminate' THEN 2 ELSE 0 END AS exit_code FROM documents""",
)
def status(spark, folder):
    verified = verify_queries(query_texts(spark, folder), PAYMENTS)
    return verified.select("doc_id", "status", "weak_guard", "exit_code")


@register(
    "referenced_tables",
    f"SELECT doc_id, {_TABLES} AS tables FROM documents",
)
def tables(spark, folder):
    verified = verify_queries(query_texts(spark, folder), PAYMENTS)
    return verified.select("doc_id", F.array_join("referenced_tables", ",").alias("tables"))


@register(
    "scan_corpus",
    f"""WITH scanned AS (SELECT doc_id, {_BOTH} AS status, {_ONE} AS first FROM documents)
SELECT doc_id, status, CASE WHEN first = 'violation' THEN '{PAYMENTS}'
  WHEN status = 'violation' THEN '{DISPUTES}' END AS post_outcome_table, {_WHY} AS reason,
  {_TABLES} AS tables, {_WEAK} AS weak_guard FROM scanned""",
)
def scan(spark, folder):
    scanned = scan_corpus(query_texts(spark, folder), [PAYMENTS, DISPUTES])
    return scanned.select(
        "doc_id", "status", "post_outcome_table", "reason", F.array_join("referenced_tables", ",").alias("tables"), "weak_guard"
    )


@register(
    "scan_summary",
    f"""WITH scanned AS (SELECT {_BOTH} AS status FROM documents)
SELECT count(*) AS scanned, count(*) FILTER (WHERE status = 'violation') AS violations,
  count(*) FILTER (WHERE status = 'safe') AS safe,
  count(*) FILTER (WHERE status = 'indeterminate') AS unparseable,
  count(*) FILTER (WHERE status = 'not_applicable') AS not_applicable,
  CASE WHEN count(*) FILTER (WHERE status = 'violation') > 0 THEN 3
    WHEN count(*) FILTER (WHERE status = 'indeterminate') > 0 OR count(*) = 0 THEN 2 ELSE 0 END AS exit_code
FROM scanned""",
)
def summary(spark, folder):
    return scan_summary(scan(spark, folder))


@register(
    "resolve_templating",
    """SELECT doc_id, source, 'select * from stg_' || source || ' join raw.t_' || lang || ' using (k)  where _templated_ = 1'
  AS resolved FROM documents""",
)
def templating(spark, folder):
    model = F.concat(
        F.lit("{{ config(x='"), "lang", F.lit("') }}{# "), F.regexp_replace("text", r"[{}#%]", " "),
        F.lit(" #}{% if x %}select * from {{ ref('stg_"), "source", F.lit("') }} join {{ source(\"raw\", 't_"),
        "lang", F.lit("') }} using (k) {% endif %}where {{ var('x') }} = 1"),
    )
    resolved = F.trim(guard.resolve_templating(model))
    return table(spark, folder, "documents").select("doc_id", "source", resolved.alias("resolved"))


@register(
    "scan_event_texts",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'violation' WHEN 1 THEN 'safe' ELSE 'not_applicable' END
  AS status FROM events""",
)
def event_texts(spark, folder):
    """Many short statements, as a query log holds them."""
    at = F.concat(F.lit("select * from a join "), F.when(F.col("event_id") % 3 < 2, "payments_after")
                  .otherwise("visits"), F.lit(" p on p.k = a.k and a.v = '"), "props", F.lit("'"))
    cut = F.when(F.col("event_id") % 3 == 1, " and p.available_at < a.prediction_time").otherwise("")
    log = table(spark, folder, "events").select("event_id", F.concat(at, cut).alias("sql"))
    return scan_corpus(log, [PAYMENTS]).select("event_id", "status")


@register(
    "scan_folder",
    f"SELECT {_BOTH} AS status, count(*) AS texts FROM documents GROUP BY ALL",
)
def scan_folder(spark, folder):
    """The corpus written as a table of texts and scanned from there."""
    path = fresh_path(spark, "corpus")
    query_texts(spark, folder).write.parquet(path)
    scanned = scan_corpus(spark.read.parquet(path), [PAYMENTS, DISPUTES])
    return scanned.groupBy("status").agg(F.count(F.lit(1)).alias("texts"))
