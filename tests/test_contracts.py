"""Files under options, titles that differ, drafts for something else, categories of a report."""

from folio.operators import guards, incremental, parse, reports


def test_files_of_options(spark):
    runs = spark.createDataFrame([("plain", False, None), ("both", True, True), ("pdf", True, False)], "run_id string, render_qa boolean, semantic_qa boolean")
    always = [(r, a) for r in ("plain", "both", "pdf") for s in incremental.STEPS for a in incremental.EXPECTED[s]]
    files = spark.createDataFrame([*always, ("both", "presentation.pdf")], "run_id string, artifact string")
    lost = {tuple(r) for r in incremental.missing_artifacts(runs, files).collect()}
    assert lost == {("both", "qa", "semantic_qa.json"), ("both", "package", "semantic_qa.json"), ("pdf", "qa", "presentation.pdf"), ("pdf", "package", "presentation.pdf")}
    assert incremental.missing_artifacts(runs.select("run_id"), files).isEmpty()


def test_titles_that_differ(spark):
    title = lambda *rows: spark.createDataFrame(list(rows), "paper_id string, title string")
    got = parse.merge_warnings(title(("a", "One  Title"), ("b", "X"), ("c", None), ("d", "Y")), title(("a", "one title"), ("b", "Z"), ("c", "Z"), ("d", "")))
    assert [tuple(r) for r in got.collect()] == [("b", "titles differ: X / Z")]


def test_drafts_for_something_else(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "paper_id string, mode string, language_profile string")
    got = {tuple(r) for r in guards.draft_problems(rows(("a", "m", "zh"), ("b", "x", None), ("d", "m", "zh")), rows(("a", "m", "zh"), ("b", "m", "zh"), ("c", "m", "zh"))).collect()}
    assert got == {("b", "mode", "m", "x"), ("b", "language_profile", "zh", None), ("c", "mode", "m", None), ("c", "language_profile", "zh", None), ("d", "mode", None, "m"), ("d", "language_profile", None, "zh")}


def test_categories_of_a_report(spark):
    all4 = [k for k, _ in reports.CATEGORY_LABELS]
    rows = [("a", c) for c in all4] + [("b", c) for c in all4[:3]] + [("b", "other")]
    got = [(r["paper_id"], list(r["lacking"]), list(r["strange"])) for r in reports.category_problems(spark.createDataFrame(rows, "paper_id string, category string")).collect()]
    assert got == [("b", [all4[3]], ["other"])]
