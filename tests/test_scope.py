"""Closure, circles and scope of semantic drafts on small decks."""

import pytest

from folio.operators import scope


def edges(spark, pairs):
    return spark.createDataFrame([(p, a, b) for p, a, b in pairs], "paper_id int, slide_id string, needs string")


def test_closure_has_the_shortest_chains(spark):
    e = edges(spark, [(1, "a", "b"), (1, "b", "c"), (1, "c", "d"), (1, "a", "c"), (1, "a", "b"), (2, "a", "b"), (2, "b", "a"), (2, "c", "a"), (2, "x", "x")])
    got = {tuple(r) for r in scope.closure(e).select("paper_id", "slide_id", "needs", "depth").collect()}
    one = {(1, "a", "b", 1), (1, "a", "c", 1), (1, "a", "d", 2), (1, "b", "c", 1), (1, "b", "d", 2), (1, "c", "d", 1)}
    assert got == one | {(2, "a", "b", 1), (2, "a", "a", 2), (2, "b", "a", 1), (2, "b", "b", 2), (2, "c", "a", 1), (2, "c", "b", 2), (2, "x", "x", 1)}
    assert {(r["paper_id"], r["slide_id"], tuple(r["members"])) for r in scope.cycles(scope.closure(e)).collect()} == {(2, "a", ("a", "b")), (2, "b", ("a", "b")), (2, "x", ("x",))}


def test_chains_that_are_too_long(spark):
    with pytest.raises(ValueError, match="more than 2 steps"):
        scope.closure(edges(spark, [(1, "a", "b"), (1, "b", "c"), (1, "c", "d")]), max_depth=2)
    assert scope.closure(edges(spark, [(1, "a", "b"), (1, "b", "c")]), max_depth=3).count() == 3


def test_scope_problems(spark):
    slides = spark.createDataFrame([(1, "a", 1, ["e1"]), (1, "b", 2, ["e2", "e3"]), (2, "a", 1, []), (3, "a", 1, None)], "paper_id int, slide_id string, order int, evidence_ids array<string>")
    evaluations = spark.createDataFrame([(1, 1, "b", ["e2", "e9"]), (1, 2, "a", ["e1", None]), (1, 3, "z", ["e1"]), (3, 1, "a", None)], "paper_id int, pos int, slide_id string, evidence_ids array<string>")
    depends = spark.createDataFrame([(1, "b", ["a", "q", "p", "q"]), (2, "a", ["b"]), (3, "a", None)], "paper_id int, slide_id string, prerequisite_slide_ids array<string>")
    nodes = spark.createDataFrame([(1, "e1"), (1, "e3"), (2, "e2")], "paper_id int, id string")
    got = {tuple(r) for r in scope.scope_problems(slides, evaluations, depends, nodes).collect()}
    assert got == {
        (1, "evaluation_order", "b", "a/b"), (1, "evaluation_order", "a", "b/a"), (1, "evaluation_order", "z", "/z"), (2, "evaluation_order", "a", "a/"),
        (1, "foreign_evidence", "b", "e2, e9"), (1, "foreign_evidence", "z", "e1"), (1, "unknown_prerequisite", "b", "p, q"), (2, "unknown_prerequisite", "a", "b"),
    }
    none = scope.scope_problems(slides.limit(0), evaluations.limit(0), depends.limit(0), nodes.limit(0))
    assert none.isEmpty() and scope.closure(scope.needs(depends.limit(0))).isEmpty()


def test_late_prerequisites(spark):
    closed = scope.closure(edges(spark, [(1, "a", "b"), (1, "b", "c"), (1, "c", "a")]))
    at = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "paper_id int, slide_id string, order int")
    assert {(r["slide_id"], r["needs"]) for r in scope.late_prerequisites(closed, at).collect()} == {("a", "b"), ("a", "c"), ("b", "c"), ("a", "a"), ("b", "b"), ("c", "c")}
