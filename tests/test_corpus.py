"""The guard scan on hand-written statements, templated models and folders of files."""

from __future__ import annotations

import pytest

from cutline.operators.corpus import scan_corpus, scan_summary, verify_queries
from cutline.sources.corpus import read_sql_corpus

TARGET = "raw.events_after"
JOINED = "select a.id from apps as a left join events_after as e on e.k = a.k"
STATEMENTS = [
    ("unguarded", JOINED + " group by a.id", "violation"),
    ("guarded", JOINED + "\n  and e.available_at <= a.prediction_time group by a.id", "safe"),
    ("strictly before", JOINED + " and e.available_at < a.prediction_time", "safe"),
    ("mirrored", "select 1 from apps a join raw.events_after e on a.prediction_time >= e.available_at", "safe"),
    ("no alias", "select 1 from events_after, apps a where events_after.available_at < a.prediction_time", "safe"),
    ("wrapped", JOINED + " and coalesce(e.available_at, e.ts) <= date_trunc('day', a.prediction_time)", "safe"),
    ("nested calls", JOINED + " and f(g(h(e.available_at, 1), 2), 3) <= a.prediction_time", "safe"),
    ("full qualifier", "select 1 from raw.events_after, apps where raw.events_after.available_at <= apps.prediction_time", "safe"),
    ("quoted", 'select 1 from "events_after" as "e" join a on "e"."available_at" <= "a"."prediction_time"', "safe"),
    ("backticks", "select 1 from `raw`.`events_after` e join a on e.`available_at` <= a.`prediction_time`", "safe"),
    ("upper case", "SELECT 1 FROM PROD.RAW.EVENTS_AFTER E JOIN A ON E.AVAILABLE_AT <= A.PREDICTION_TIME", "safe"),
    ("other table's cutoff", "select 1 from events_after e join apps a using (k) join log l using (k) where l.available_at <= a.prediction_time", "violation"),
    ("in a comment", "select 1 from events_after e -- e.available_at <= a.prediction_time\n join apps a on a.k = e.k", "violation"),
    ("in a block comment", JOINED + " /* and e.available_at <= a.prediction_time */", "violation"),
    ("in a literal", "select 'e.available_at <= a.prediction_time' from events_after e", "violation"),
    ("across clauses", "select 1 from events_after e join a on e.available_at <= a.cutoff and a.prediction_time > x", "violation"),
    ("across a list", "select e.available_at, x < a.prediction_time from events_after e, a", "violation"),
    ("unqualified", "select 1 from events_after where available_at <= prediction_time", "violation"),
    ("between", "select 1 from events_after e where e.available_at between a.x and a.prediction_time", "violation"),
    ("wrong direction", JOINED + " and e.available_at >= a.prediction_time", "violation"),
    ("equality", JOINED + " and e.available_at = a.prediction_time", "violation"),
    ("null-safe equality", JOINED + " and e.available_at <=> a.prediction_time", "violation"),
    ("not equal", JOINED + " and e.available_at <> a.prediction_time", "violation"),
    ("longer column name", JOINED + " and e.available_at_utc <= a.prediction_time", "violation"),
    ("longer cutoff name", JOINED + " and e.available_at <= a.prediction_time_2", "violation"),
    ("read twice", "select 1 from a join events_after e1 on e1.available_at <= a.prediction_time join events_after e2 on e2.k = a.k", "violation"),
    ("read twice, both guarded", "select 1 from a join events_after x on x.available_at <= a.prediction_time join events_after y on y.available_at <= a.prediction_time", "safe"),
    ("in a cte", "with x as (select * from events_after e join a on e.available_at <= a.prediction_time) select * from x", "safe"),
    ("second in a list", "select 1 from apps a, events_after e where e.k = a.k", "violation"),
    ("after a subquery", "select 1 from (select * from y) z, events_after e", "indeterminate"),
    ("bracketed join", "select 1 from (events_after e join a on e.k = a.k)", "indeterminate"),
    ("another schema, same table", "select * from staging.events_after", "violation"),
    ("other table", "select * from apps", "not_applicable"),
    ("longer table name", "select * from events_after_2", "not_applicable"),
    ("only in a comment", "select 1 /* from events_after */ from b", "not_applicable"),
    ("no table", "select 1 as x;", "not_applicable"),
    ("expression from", "select extract(day from events.ts) from events where a is distinct from b", "not_applicable"),
    ("dashes in a quoted name", 'select a."x--y", e.v from apps a join events_after e on e.k = a.k', "violation"),
    ("comment sign in backticks", "select a.`x/*y`, e.v from apps a join events_after e on e.k = a.k /* z */", "indeterminate"),
    ("dashes between dollars", "select $$ -- $$, e.v from apps a join events_after e on e.k = a.k", "violation"),
    ("text between tagged dollars", "select $q$ from events_after $q$ from b", "not_applicable"),
    ("table of a macro", "select * from {{ var('src') }} p", "indeterminate"),
    ("prose", "this is not sql at all !!! ((", "indeterminate"),
    ("keywords only", "SELECT FROM WHERE", "indeterminate"),
    ("open bracket", "select (1 from events_after", "indeterminate"),
    ("open literal", "select 'abc from events_after", "indeterminate"),
    ("empty", "", "indeterminate"),
    ("nothing", None, "indeterminate"),
]


def test_statements(spark):
    corpus = spark.createDataFrame([(n, s) for n, s, _ in STATEMENTS], "name string, sql string")
    got = {r["name"]: r["status"] for r in verify_queries(corpus, TARGET).collect()}
    assert got == {n: status for n, _, status in STATEMENTS}
    scanned = {r["name"]: r["status"] for r in scan_corpus(corpus, [TARGET]).collect()}
    assert scanned == got


def test_the_report_names_tables_and_predicates(spark):
    corpus = spark.createDataFrame([(s,) for _, s, _ in STATEMENTS[:2]], "sql string")
    bad, good = sorted(verify_queries(corpus, TARGET).collect(), key=lambda r: -r["exit_code"])
    assert bad["referenced_tables"] == ["apps", "events_after"] and bad["cutoff_predicates"] == []
    assert "never mentioned" in bad["reason"] and bad["exit_code"] == 3
    assert good["cutoff_predicates"] == ["e.available_at <= a.prediction_time"]
    assert good["exit_code"] == 0 and not good["weak_guard"]


@pytest.mark.parametrize(
    ("tail", "weak"),
    [
        (" and e.available_at <= a.prediction_time or 1 = 1", True),
        (" and e.available_at <= a.prediction_time + interval '3 days'", True),
        (" and not (e.available_at <= a.prediction_time)", True),
        (" and e.available_at <= a.prediction_time where a.x is not null", False),
    ],
)
def test_guards_that_may_not_bind_are_marked(spark, tail, weak):
    row = verify_queries(spark.createDataFrame([(JOINED + tail,)], "sql string"), TARGET).first()
    assert (row["status"], row["weak_guard"]) == ("safe", weak)


@pytest.mark.parametrize(
    ("written", "nominated"),
    [
        ("events_after", "events_after"),
        ("raw.events_after", "events_after"),
        ("prod.raw.events_after", "raw.events_after"),
        ("events_after", "raw.events_after"),
        ("EVENTS_AFTER", "events_after"),
    ],
)
def test_qualified_names_match_in_both_directions(spark, written, nominated):
    corpus = spark.createDataFrame([(f"SELECT * FROM {written};",)], "sql string")
    assert scan_corpus(corpus, [nominated]).first()["status"] == "violation"


def test_long_statements_are_read_whole(spark):
    many = " , ".join(f"a.c{i}" for i in range(4_000))
    hidden = "x " * 200_000
    texts = [
        (f"select {many} from apps a join events_after e on e.k = a.k", "violation"),
        (f"select {many} /* {hidden} */ from apps a join events_after e on e.available_at <= a.prediction_time", "safe"),
        (f"select '{hidden}' from apps a where a.v in ({many})", "not_applicable"),
        (f"select 1 from apps a join events_after e on {' and '.join(['a.x = 1'] * 5_000)} and e.available_at <= a.prediction_time", "safe"),
    ]
    corpus = spark.createDataFrame(texts, "sql string, want string")
    for row in verify_queries(corpus, TARGET).collect():
        assert row["status"] == row["want"]


def test_several_tables_take_the_worst_and_name_the_first_violated(spark):
    text = JOINED + " and e.available_at <= a.prediction_time join refunds r on r.k = a.k"
    corpus = spark.createDataFrame([(text,)], "sql string")
    row = scan_corpus(corpus, ["events_after", "refunds"]).first()
    assert (row["status"], row["post_outcome_table"]) == ("violation", "refunds")
    with pytest.raises(ValueError):
        scan_corpus(corpus, [])


def write(folder, files):
    for name, content in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())


def scan(spark, root):
    return scan_summary(scan_corpus(read_sql_corpus(spark, str(root)), [TARGET])).first().asDict()


def test_folders_are_scanned(spark, tmp_path):
    write(
        tmp_path / "target" / "models",
        {
            "mine.sql": "select 1;",
            "deep/er/leak.SQL": JOINED,
            "broken.sql": b"\xff\xfe\x00 no text \xff",
            "readme.md": "select * from events_after",
            "dbt_packages/vendor.sql": JOINED,
            "node_modules/x/vendor.sql": JOINED,
            "target/compiled.sql": JOINED,
        },
    )
    # The root itself lies under a folder called target: that must not hide it.
    root = tmp_path / "target" / "models"
    assert scan(spark, root) == {
        "scanned": 3, "violations": 1, "safe": 0, "unparseable": 1, "not_applicable": 1, "exit_code": 3,
    }
    paths = {r["path"] for r in read_sql_corpus(spark, str(root)).collect()}
    assert paths == {"mine.sql", "deep/er/leak.SQL", "broken.sql"}


def test_exit_codes_of_folders(spark, tmp_path):
    write(tmp_path, {"clean/ok.sql": "select 1;", "odd/odd.sql": b"\xff", "none/readme.md": "x"})
    assert scan(spark, tmp_path / "clean")["exit_code"] == 0
    assert scan(spark, tmp_path / "odd")["exit_code"] == 2
    # Nothing scanned is not a pass.
    assert scan(spark, tmp_path / "none")["exit_code"] == 2
    single = scan(spark, tmp_path / "clean" / "ok.sql")
    assert (single["scanned"], single["exit_code"]) == (1, 0)


@pytest.mark.parametrize(
    ("model", "status"),
    [
        ("{{ config(materialized='table') }} select 1 from {{ ref('apps') }} a left join {{ ref('events_after') }} as e on e.k = a.k", "violation"),
        ("select 1 from {{ref(\"apps\")}} a join {{ ref('shop', 'events_after') }} e on e.available_at <= a.prediction_time", "safe"),
        ("{# from events_after #}\n{% if x %} select * from {{ source('raw', 'apps') }} {% endif %}", "not_applicable"),
        ("select {{ var('x') }} from {{ source('raw', 'events_after') }}", "violation"),
    ],
)
def test_templated_models(spark, model, status):
    corpus = spark.createDataFrame([(model,)], "sql string")
    assert scan_corpus(corpus, [TARGET]).first()["status"] == status


CUT = "p.available_at <= a.prediction_time"
BASE = "select 1 from apps a join payments_after p on p.k = a.k"


@pytest.mark.parametrize(
    ("sql", "expected"),
    [
        (f"{BASE} and {'(' * 3000}{CUT}{')' * 3000}", "safe"),
        (f"{BASE} and p.k in ({', '.join(map(str, range(60000)))}) and {CUT}", "safe"),
        (f"select case when {CUT} then 1 end from apps a join payments_after p on p.k = a.k", "violation"),
        (f"select distinct on (a.k) {CUT} as ok from apps a join payments_after p on p.k = a.k", "violation"),
        (f"{BASE} group by 1 having {CUT}", "violation"),
        (f"{BASE} where (select max(x) from b where b.available_at is not null) <= a.prediction_time", "violation"),
        (f"select 1 from apps a, (select * from payments_after p join apps a on {CUT}) late", "safe"),
        (f"select count(*) filter (where {CUT}) from apps a join payments_after p on p.k = a.k", "safe"),
        (f"{BASE}; select 1 where {CUT}", "safe"),
        ("select U&'p\\0061yments', p.v from apps a join payments_after p on p.k = a.k", "indeterminate"),
        (f"select 1 from apps a join payments_after p on p.k = a.k # it's\n and {CUT}", "indeterminate"),
        (f"select d #> '{{a}}' from apps a join payments_after p on {CUT}", "safe"),
        ("select 'it\\'s' from apps", "not_applicable"),
        ("select E'it\\'s -- payments_after' from apps", "not_applicable"),
        (f"select E'\\\\' from apps a join payments_after p on {CUT} where a.x = ''", "safe"),
    ],
)
def test_conditions_at_any_depth_and_literals(spark, sql, expected):
    row = verify_queries(spark.createDataFrame([(sql,)], "sql string"), "raw.payments_after").first()
    assert row["status"] == expected
