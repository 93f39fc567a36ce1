"""Paths with cycles, ties, no answer and no catalog."""

from __future__ import annotations

import random

from conftest import rows
from pyspark.sql import functions as F

from cutline import session
from cutline.operators import lineage
from cutline.operators.lineage import column_path, path_nodes, suspicious_ancestry, upstream
from cutline.sources.cases import EDGES, path_from_response, read_edges

GRAPH = [
    ("a.x", "b.x", None), ("a.x", "c.x", "q1"), ("b.x", "d.x", None), ("c.x", "d.x", None),
    ("d.x", "a.x", None), ("d.x", "e.x", None), ("f.x", "e.x", None), ("a.x", "b.x", "q2"),
]


def found(spark, edges, pairs, **options):
    frame = column_path(
        spark.createDataFrame(edges, EDGES), spark.createDataFrame(pairs, "source string, target string"), **options
    )
    return {(r["source"], r["target"]): r for r in frame.collect()}


def test_shortest_path_with_ties_by_text_and_cycles(spark):
    pairs = [("a.x", "e.x"), ("a.x", "a.x"), ("d.x", "c.x"), ("e.x", "a.x"), ("a.x", "f.x"), ("zz", "a.x")]
    got = found(spark, GRAPH, pairs)
    assert got["a.x", "e.x"]["path"] == ["a.x", "b.x", "d.x", "e.x"] and got["a.x", "e.x"]["hops"] == 3
    assert got["a.x", "a.x"]["path"] == ["a.x"] and got["a.x", "a.x"]["hops"] == 0
    assert got["d.x", "c.x"]["path"] == ["d.x", "a.x", "c.x"]
    for pair in (("e.x", "a.x"), ("a.x", "f.x"), ("zz", "a.x")):
        row = got[pair]
        # Asked and answered "no": evidence against a leak.
        assert (row["available"], row["found"], row["hops"], row["path"]) == (True, False, 0, [])


def test_queries_between_columns_are_listed_on_request(spark):
    got = found(spark, GRAPH, [("a.x", "c.x"), ("a.x", "b.x")], with_queries=True)
    assert got["a.x", "c.x"]["path"] == ["a.x", "q1", "c.x"] and got["a.x", "c.x"]["hops"] == 2
    # The same step is known with and without its query: the smaller text wins.
    assert got["a.x", "b.x"]["path"] == ["a.x", "b.x"]


def test_ancestry_in_cycles(spark):
    edges = spark.createDataFrame(
        [("s", "y", None), ("y", "s", None), ("s", "f", None), ("f", "g", None), ("t", "g", None), ("t", "u", None)],
        EDGES,
    )
    features = spark.createDataFrame([(n,) for n in ("f", "g", "u")], "node string")
    outcomes = spark.createDataFrame([("y",)], "node string")
    # Through the cycle f and g descend from the outcome itself.
    assert rows(suspicious_ancestry(edges, features, outcomes)) == [("f", False), ("g", False), ("u", False)]


def test_an_absent_catalog_is_no_answer(spark):
    row = found(spark, [], [("a.x", "a.x"), ("a.x", "b.x")])["a.x", "b.x"]
    assert (row["available"], row["found"]) == (False, False)


def test_no_pairs_and_wide_fan_out(spark):
    assert found(spark, GRAPH, []) == {}
    # Branches that lead to no target are never walked.
    fan = [("a.x", f"leaf{i}", None) for i in range(500)] + [("a.x", "b.x", None)]
    assert found(spark, fan, [("a.x", "b.x")])["a.x", "b.x"]["hops"] == 1


def test_hops_are_bounded(spark):
    chain = [(f"n{i}", f"n{i + 1}", None) for i in range(10)]
    assert not found(spark, chain, [("n0", "n9")], max_hops=8)["n0", "n9"]["found"]
    assert found(spark, chain, [("n0", "n9")], max_hops=9)["n0", "n9"]["hops"] == 9


def test_upstream_closure(spark):
    nodes = spark.createDataFrame([("e.x",)], "node string")
    edges = spark.createDataFrame(GRAPH, EDGES)
    assert rows(upstream(edges, nodes, max_hops=2)) == [
        ("e.x", "b.x", 2), ("e.x", "c.x", 2), ("e.x", "d.x", 1), ("e.x", "f.x", 1)
    ]


def test_suspicious_ancestry_needs_a_shared_source_and_no_directed_path(spark):
    edges = spark.createDataFrame(
        [
            ("src.a", "label.y", None), ("src.a", "feat.shared", None),
            ("label.y", "feat.leaky", None), ("src.b", "feat.clean", None),
        ],
        EDGES,
    )
    features = spark.createDataFrame([(f"feat.{n}",) for n in ("shared", "leaky", "clean", "alone")], "node string")
    outcomes = spark.createDataFrame([("label.y",)], "node string")
    assert rows(suspicious_ancestry(edges, features, outcomes)) == [
        ("feat.alone", False), ("feat.clean", False), ("feat.leaky", False), ("feat.shared", True)
    ]


def test_path_nodes(spark):
    schema = "id int, path array<string>, late boolean, model string"
    paths = spark.createDataFrame([(1, ["a.x.y", "b"], True, "m"), (2, [], True, "m")], schema)
    assert rows(path_nodes(paths, "late", "model")) == [
        (1, 0, "a", "x.y", "source", True), (1, 1, "b", "", "feature", False), (1, 2, "m", "", "model", False)
    ]


def test_catalog_answers_of_several_shapes(spark):
    answers = [
        ('{"paths": [["a", "b"]]}', ["a", "b"]),
        ('{"lineage_paths": [[{"column": "a"}, {"name": "b"}]]}', ["a", "b"]),
        ('{"results": [{"hops": [{"urn": "a"}, {"entity": "b"}]}]}', ["a", "b"]),
        ('{"paths": []}', []),
        ('{"other": [["a"]]}', []),
        ("no json", []),
        (None, []),
    ]
    frame = spark.createDataFrame(answers, "answer string, want array<string>")
    for row in frame.withColumn("got", path_from_response(F.col("answer"))).collect():
        assert row["got"] == row["want"], row


def test_edges_are_read_from_an_export(spark, tmp_path):
    spark.createDataFrame(GRAPH, EDGES).write.parquet(str(tmp_path / "edges"))
    assert read_edges(spark, str(tmp_path / "edges")).count() == len(GRAPH)


def test_long_chain_is_found(spark):
    """A path of 16 hops, beyond any fixed bound, and a cycle that must end."""
    links = [(f"t.c{i}", f"t.c{i + 1}", None) for i in range(16)] + [("t.c5", "t.c2", None)]
    edges = spark.createDataFrame(links, "src_node string, dst_node string, via string")
    pairs = spark.createDataFrame([("t.c0", "t.c16"), ("t.c16", "t.c0")], "source string, target string")
    got = {(r["source"], r["found"], r["hops"]) for r in column_path(edges, pairs).collect()}
    assert got == {("t.c0", True, 16), ("t.c16", False, 0)}


def test_many_sources_share_the_walks_of_their_targets(spark, monkeypatch):
    """The same answers from either end; what is written between follows the shared nodes and not the sources."""
    rng = random.Random(7)
    inner = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.choice([None, None, "q1", "q2"])) for _ in range(90)]
    leaves = [(f"s{i}", f"n{rng.randrange(40)}", rng.choice([None, "q3"])) for i in range(200) for _ in range(rng.randrange(3))]
    pairs = [(f"s{i}", f"n{rng.randrange(5)}") for i in range(200) for _ in range(2)]
    pairs += [(f"n{i}", f"n{rng.randrange(5)}") for i in range(40)] + [("s1", None), (None, "n1"), (None, None), ("gone", "n1")]
    edges = inner + leaves + [("s0", "s0", None), (None, "n1", None), ("n3", None, None), *inner[:20]]
    written = []

    def stored(frame, name):
        written.append(session.stored(frame, name))
        return written[-1]

    monkeypatch.setattr(lineage, "stored", stored, raising=False)
    for hops, queries in ((None, True), (2, False)):
        monkeypatch.setattr(lineage, "SHARED", 10**9, raising=False)
        forward = found(spark, edges, pairs, max_hops=hops, with_queries=queries)
        monkeypatch.setattr(lineage, "SHARED", 1, raising=False)
        assert not written
        assert found(spark, edges, pairs, max_hops=hops, with_queries=queries) == forward
        assert hops or sum(r["found"] for r in forward.values()) > 100
        walks = [frame.count() for frame in written if "hops" in frame.columns]
        assert walks and sum(walks) <= 5 * 41
        written.clear()
