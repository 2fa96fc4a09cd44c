"""Whole flows on small papers."""

import pytest
from pyspark.sql import functions as F
from test_operators import TEX, UNITS, deck, plan  # noqa: F401

from folio.operators import incremental
from folio.plans import flows


def test_paper_to_evidence(spark):
    tex = spark.createDataFrame([("p", TEX)], "paper_id string, text string")
    pages = spark.createDataFrame([("p", 1, "Intro Part\nsome text goes on."), ("q", 1, "Only Pages\nmore text, here.")], "paper_id string, page int, text string")
    paper = flows.parse_papers(tex, pages)
    assert {(r["paper_id"], r["section_id"], r["source"]) for r in paper["paragraphs"].select("paper_id", "section_id", "source").distinct().collect()} == {("p", "sec_tex_001", "latex"), ("p", "sec_tex_003", "latex"), ("p", "sec_tex_006", "latex"), ("p", None, "pdf"), ("q", "sec_pdf_001", "pdf")}
    catalog = flows.source_catalog(paper)
    claims = spark.createDataFrame([("p", 0, "method", "method", "Attention maps queries", "high"), ("p", 1, "problem", "problem", "Sequences", "high")], "paper_id string, claim_index int, category string, type string, claim string, confidence string")
    refs = spark.createDataFrame([("p", 0, 0, "para_tex_00002", "attention function MAPS"), ("p", 1, 0, "para_tex_00001", "a task")], "paper_id string, claim_index int, pos int, source_id string, excerpt string")
    links = spark.createDataFrame([("p", 0, 1, "supports")], "paper_id string, source_claim_index int, target_claim_index int, relation string")
    got = flows.build_evidence(claims, refs, links, catalog)
    assert got["nodes"].count() == 2 and got["edges"].count() == 1
    with pytest.raises(flows.GateError):
        flows.build_evidence(claims, refs.withColumn("excerpt", F.lit("absent")), links, catalog)


def test_plan_flow(spark):
    nodes = spark.createDataFrame([("p", "e", "score 3.5")], "paper_id string, id string, claim string")
    units = plan(spark).withColumn("main_claim", F.lit("score 3.50")).withColumn("evidence_ids", F.array(F.lit("e")))
    got = flows.build_plan(units, nodes, "paper-reading", 345)
    assert got["units"].count() == 6 and [r["label"] for r in got["gaps"].collect()] == ["research gap"] and got["violations"].count() == 0
    bad = flows.build_plan(units.withColumn("main_claim", F.lit("We propose 9")), nodes, "paper-reading", strict=False)["violations"]
    assert {r["rule"] for r in bad.collect()} == {"own_voice", "unsupported_number"}
    with pytest.raises(flows.GateError):
        flows.build_plan(units, nodes, "paper-reading", 300)


def test_qa_flow(deck):  # noqa: F811
    s = deck["slides"].withColumn("title", F.when(F.col("order") == 2, "On topic2。").otherwise(F.col("title")))
    got = flows.run_qa(deck | {"slides": s})
    assert got["actions"].count() == 1 and got["issues"].where("code = 'TITLE_TRAILING_PUNCTUATION'").count() == 0
    assert {r["category"]: r["status"] for r in got["categories"].collect()} == {"factual": "pass", "storyline": "fail", "visual": "pass", "presentation": "pass"}
    assert got["status"].first()["status"] == "fail"


def test_render_names_missing_slides_by_paper(spark):
    s = spark.createDataFrame([("p", "s1", 1), ("p", "s2", 2), ("q", "s1", 1)], "paper_id string, slide_id string, number int")
    with pytest.raises(flows.GateError, match="'q'.*2"):
        flows.render_deck(s, None, None, None, [2])


def test_findings_are_in_order_and_sized_by_their_package(deck, spark):  # noqa: F811
    paper = deck["slides"].first()["paper_id"]
    first = deck["slides"].orderBy("order").first()["slide_id"]
    boxes = spark.createDataFrame([(paper, first, 0, "text", 0, 0, 9000, 9000, 20.0, False)], "paper_id string, slide_id string, i long, text string, x long, y long, cx long, cy long, font double, auto_fit boolean")
    size = lambda w: spark.createDataFrame([(paper, w, w, None)], "paper_id string, width long, height long, problem string")
    out = lambda w: flows.run_qa(deck | {"boxes": boxes, "packages": size(w)})["issues"].where("code = 'OUT_OF_BOUNDS_TEXT'")
    assert out(8000).first()["suggested_action"] and out(9000).isEmpty()
    issues = flows.run_qa(deck)["issues"].orderBy("pos").collect()
    groups = [("factual", "storyline", "presentation").index(r["category"]) for r in issues]
    assert [r["pos"] for r in issues] == list(range(1, len(issues) + 1)) and groups == sorted(groups)


def test_every_code_has_advice():
    import inspect
    import re

    from folio.operators import qa

    codes = set(re.findall(r'"([A-Z]{3,}(?:_[A-Z]+)+)"', inspect.getsource(qa)))
    assert codes == set(qa.ACTIONS) and all(a for _, a in qa.ACTIONS.values())


def test_papers_without_units_lack_all_stages(spark):
    from folio.operators import qa

    slides = spark.createDataFrame([("p", "s", "u", 1, "q", "m", ["e"], None, 10)], "paper_id string, slide_id string, unit_id string, `order` int, question string, main_claim string, evidence_ids array<string>, title string, notes_seconds long")
    units = spark.createDataFrame([("q", "u", 1, "q", None, ["e"], "problem", 5)], "paper_id string, unit_id string, `order` int, question string, main_claim string, evidence_ids array<string>, role string, seconds long")
    plans = spark.createDataFrame([("p", 100, [])], "paper_id string, budget int, coverage_gaps array<string>")
    got = [r["code"] for r in qa.storyline(slides, units, plans).where("paper_id = 'p'").collect()]
    assert got.count("MISSING_STORYLINE_STAGE") == 4 and "MISSING_LIMITATIONS" in got and "STORYLINE_ORDER" not in got
    drift = qa.storyline(slides, units.withColumn("paper_id", F.lit("p")), plans).where("code = 'UNIT_CONTENT_DRIFT'")
    assert drift.count() == 1  # a claim against none is drift


def test_incremental(spark):
    runs = spark.createDataFrame([("r", "f1"), ("n", "f2")], "run_id string, fingerprint string")
    files = spark.createDataFrame([("r", a) for step in incremental.STEPS[:4] for a in incremental.EXPECTED[step]], "run_id string, artifact string")
    lost = incremental.missing_artifacts(runs, files)
    assert {(r["run_id"], r["step"]) for r in lost.where("run_id = 'r'").collect()} == {("r", "render"), ("r", "qa")}
    steps = spark.createDataFrame([("r", s, "completed", "f1") for s in incremental.STEPS], "run_id string, step string, status string, fingerprint string")
    got = {(r["run_id"], r["step"]): r["action"] for r in incremental.to_do(steps, lost, runs).collect()}
    assert [got[("r", s)] for s in incremental.STEPS] == ["skip"] * 4 + ["run"] * 3 and all(got[("n", s)] == "run" for s in incremental.STEPS)
    f = [("r", "a", bytearray(b"1")), ("r", "b", bytearray(b"2"))]
    one, two = (incremental.directory_fingerprint(spark.createDataFrame(x, "run_id string, path string, content binary")).first()[1] for x in (f, f[::-1]))
    assert one == two and len(one) == 64
