"""Operators over artifact tables: mutate one thing, expect one finding."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from folio.operators import evidence, layout, parse, planning, qa, relations
from folio.plans import queries_flows
from folio.sources import files

UNITS = [("p", "u1", 1, "opening", 5, 40), ("p", "u2", 2, "problem", 5, 60), ("p", "u3", 3, "core_insight", 5, 60), ("p", "u4", 4, "method_overview", 4, 75), ("p", "u5", 5, "experiments", 5, 70), ("p", "u6", 6, "analysis", 2, 45), ("p", "u7", 7, "takeaway", 4, 40)]


def plan(spark, rows=UNITS):
    return spark.createDataFrame(rows, "paper_id string, unit_id string, `order` int, role string, importance int, seconds int")


def selected(spark, budget):
    g = F.coalesce(*[F.when(F.col("role").isin(*roles), F.lit(k)) for k, roles in enumerate(planning.ROLE_GROUPS)])
    u = planning.required_units(plan(spark).withColumn("g", g), "paper_id", "g", "importance", "order")
    low = planning.narrative_minimum(u, "paper_id", "seconds", F.lit(budget)).collect()
    return [r["unit_id"] for r in planning.select_within_budget(u, "paper_id", "unit_id", "importance", "order", "seconds", F.lit(budget)).orderBy("new_order").collect()], low


def test_selection(spark):
    assert selected(spark, 390)[0] == [u[1] for u in UNITS]
    assert selected(spark, 345) == (["u1", "u2", "u3", "u4", "u5", "u7"], [])
    kept, low = selected(spark, 304)
    assert kept == [] and low[0]["minimum"] == 305


def test_sequence(spark):
    assert planning.sequence_violations(plan(spark)).count() == 0
    moved = [(*u[:2], {2: 4, 4: 2}.get(u[2], u[2]), *u[3:]) for u in UNITS]
    assert {r["rule"] for r in planning.sequence_violations(plan(spark, moved)).collect()} == {"order_1", "order_2"}
    late = [(*u[:2], 9 if u[1] == "u1" else u[2], *u[3:]) for u in UNITS]
    assert {r["rule"] for r in planning.sequence_violations(plan(spark, late)).collect()} == {"opening_first", "ending_last"}


def test_coverage(spark):
    gaps = planning.coverage_gaps(plan(spark).select("paper_id", "role"), planning.coverage_labels(spark, "paper-reading"))
    assert [r["label"] for r in gaps.collect()] == ["research gap"]


@pytest.fixture
def deck(spark):
    s = [("p", f"s{i}", f"u{i}", i, f"Title number {i}", "q", f"Claim about topic{i} is 3.5", ["body"], "", "why", ["e1"], f"Claim about topic{i} is 3.5", "why", f"We speak of topic{i}.", "下一页" if i < 3 else "结束", 60, "minimal_text") for i in (1, 2, 3)]
    slides = spark.createDataFrame(s, "paper_id string, slide_id string, unit_id string, `order` int, title string, question string, main_claim string, body array<string>, takeaway string, purpose string, evidence_ids array<string>, notes_message string, notes_purpose string, notes_script string, notes_transition string, notes_seconds int, layout string")
    slides = slides.withColumn("title", F.concat(F.lit("On topic"), "order"))
    roles = {1: "problem", 2: "method_overview", 3: "experiments"}
    units = [("p", f"u{i}", i, roles[i], "q", f"Claim about topic{i} is 3.5", ["e1"], 60) for i in (1, 2, 3)]
    schema = "paper_id string, unit_id string, `order` int, role string, question string, main_claim string, evidence_ids array<string>, seconds int"
    return {
        "slides": slides,
        "units": spark.createDataFrame(units, schema),
        "plans": spark.createDataFrame([("p", 200, ["x"])], "paper_id string, budget int, coverage_gaps array<string>"),
        "citations": spark.createDataFrame([("p", f"s{i}", "e1", ["src"]) for i in (1, 2, 3)], "paper_id string, slide_id string, evidence_id string, source_ids array<string>"),
        "nodes": spark.createDataFrame([("p", "e1", "method", "It is 3.50", "high", ["src"], ["text 1, 2 and 3"])], "paper_id string, id string, type string, claim string, confidence string, source_ids array<string>, excerpts array<string>"),
        "visuals": spark.createDataFrame([("p", "s1", "source_asset", "a1", "full", "main")], "paper_id string, slide_id string, kind string, source_ref string, treatment string, role string"),
        "known": spark.createDataFrame([("p", "source_asset", "a1", True)], "paper_id string, kind string, source_ref string, intact boolean"),
    }


def factual(d):
    return {(r["code"], r["slide_ids"][0]) for r in qa.factual(d["slides"], d["citations"], d["visuals"], d["nodes"], d["known"]).collect()}


def test_factual(deck):
    assert factual(deck) == set()
    one = F.col("slide_id") == "s2"
    assert factual(deck | {"slides": deck["slides"].withColumn("takeaway", F.when(one, "up 99%").otherwise(""))}) == {("UNSUPPORTED_NUMBER", "s2")}
    assert factual(deck | {"slides": deck["slides"].withColumn("evidence_ids", F.when(one, F.array(F.lit("nope"))).otherwise(F.col("evidence_ids"))).withColumn("takeaway", F.when(one, "99").otherwise(""))}) == {("UNKNOWN_EVIDENCE", "s2")}
    assert factual(deck | {"citations": deck["citations"].where("slide_id <> 's3'")}) == {("MISSING_CITATION", "s3")}
    assert factual(deck | {"citations": deck["citations"].withColumn("source_ids", F.when(one, F.array(F.lit("other"))).otherwise(F.col("source_ids")))}) == {("CITATION_SOURCE_MISMATCH", "s2")}
    assert factual(deck | {"known": deck["known"].where("false")}) == {("UNKNOWN_SOURCE_ASSET", "s1")}
    assert factual(deck | {"known": deck["known"].withColumn("intact", F.lit(False))}) == {("SOURCE_ASSET_HASH_MISMATCH", "s1")}
    assert factual(deck | {"nodes": deck["nodes"].withColumn("confidence", F.lit("low"))}) == {("LOW_CONFIDENCE_EVIDENCE", f"s{i}") for i in (1, 2, 3)}
    assert factual(deck | {"nodes": deck["nodes"].withColumn("type", F.lit("ablation_result")), "visuals": deck["visuals"].withColumn("kind", F.lit("conceptual_diagram"))}) == {("GENERATED_EXPERIMENT_VISUAL", "s1")}


def test_storyline_and_presentation(deck):
    base = {"MISSING_STORYLINE_STAGE", "MISSING_LIMITATIONS", "DECLARED_COVERAGE_GAP"}  # no ending, no limitations, one gap
    codes = lambda f, d: {r["code"] for r in f(d["slides"], d["units"], d["plans"]).collect()}
    assert codes(qa.storyline, deck) == base and codes(qa.presentation, deck) == set()
    s = deck["slides"]
    assert codes(qa.storyline, deck | {"slides": s.withColumn("main_claim", F.lit("Same claim!"))}) == base | {"DUPLICATE_MAIN_CLAIM", "UNIT_CONTENT_DRIFT"}
    assert codes(qa.storyline, deck | {"slides": s.withColumn("order", 4 - F.col("order"))}) == base | {"PLAN_SPEC_ORDER_MISMATCH"}
    assert codes(qa.presentation, deck | {"slides": s.withColumn("notes_seconds", F.lit(70))}) == {"TIMING_DRIFT", "TIME_BUDGET_EXCEEDED"}
    assert codes(qa.presentation, deck | {"slides": s.withColumn("notes_transition", F.when(F.col("order") == 1, "结束").otherwise("下"))}) == {"EARLY_CLOSING_TRANSITION", "MISSING_CLOSING_TRANSITION"}
    assert codes(qa.presentation, deck | {"slides": s.withColumn("notes_script", F.lit("nothing"))}) == {"SCRIPT_CONTENT_DRIFT"}


def test_repair(deck):
    s = deck["slides"].withColumn("title", F.when(F.col("order") == 2, "On topic2。").otherwise(F.col("title")))
    found = qa.presentation(s, deck["units"], deck["plans"])
    fixed, actions = qa.safe_repairs(s, found)
    assert [(r["before"], r["after"]) for r in actions.collect()] == [("On topic2。", "On topic2")]
    assert qa.presentation(fixed, deck["units"], deck["plans"]).count() == 0


def test_semantic_and_authoring(spark, deck):
    e = spark.createDataFrame([("p", "s1", "unsupported", "r", "overstated", "r", ["e1"]), ("p", "s2", "supported", "r", "calibrated", "r", ["e1"])], "paper_id string, slide_id string, claim_evidence string, claim_evidence_rationale string, claim_strength string, claim_strength_rationale string, evidence_ids array<string>")
    d = spark.createDataFrame([("p", "s1", "c", "r", True, ["s2", "s1"]), ("p", "s2", "c", "r", True, []), ("p", "s2", "c", "r", False, [])], "paper_id string, slide_id string, concept string, rationale string, required boolean, prerequisite_slide_ids array<string>")
    got = {r["code"]: r["slide_ids"] for r in qa.semantic(deck["slides"], e, d).collect()}
    assert got == {"CLAIM_EVIDENCE_UNSUPPORTED": ["s1"], "CLAIM_STRENGTH_OVERSTATED": ["s1"], "STORYLINE_PREREQUISITE_MISSING": ["s2"], "STORYLINE_DEPENDENCY_ORDER": ["s1", "s2", "s1"]}
    v = spark.createDataFrame([("p", "s1", "source_table", "t", "diagram", "main"), ("p", "s2", "source_table", "t", "crop", "main"), ("p", "s3", "source_table", "t", "crop", "background")], "paper_id string, slide_id string, kind string, source_ref string, treatment string, role string")
    assert {r["rule"] for r in qa.authoring_violations(deck["slides"], v).collect()} == {"treatment", "reused_source", "table_layout"}


def test_evidence(spark):
    claims = spark.createDataFrame([("p", 0, "method", "method", "Uses attention", "high"), ("p", 1, "gap", "ablation_result", "Gains 4.2 points", "low")], "paper_id string, claim_index int, category string, type string, claim string, confidence string")
    refs = spark.createDataFrame([("p", 0, 0, "a", "USES  attention"), ("p", 1, 0, "a", "not there"), ("p", 1, 1, "zz", "x")], "paper_id string, claim_index int, pos int, source_id string, excerpt string")
    cat = spark.createDataFrame([("p", "a", "It uses attention, gains 4.1.")], "paper_id string, source_id string, text string")
    got = sorted((r["claim_index"], r["problem"]) for r in evidence.violations(claims, refs, cat).collect())
    assert got == [(1, "excerpt not in source"), (1, "unknown source"), (1, "unsupported numbers: 4.2")]
    n = evidence.nodes(claims, refs)
    a = {r["category"]: r["status"] for r in evidence.answers(n).collect()}
    assert len(a) == 12 and a["method"] == "grounded" and a["problem"] == "insufficient_evidence"
    e = evidence.edges(spark.createDataFrame([("p", 0, 1, "supports"), ("p", 0, 9, "x")], "paper_id string, source_claim_index int, target_claim_index int, relation string"), n).collect()
    assert sum(r["target"] is None for r in e) == 1
    src = spark.createDataFrame([("p", "e", 0, "a", "Method", None, None, None, None), ("p", "e", 1, "b", "Method", None, None, None, "3"), ("p", "e", 2, "c", "Method", None, None, None, None), ("p", "f", 0, "d", None, None, None, None, None)], "paper_id string, evidence_id string, pos int, source_id string, section string, page int, figure string, `table` string, equation string")
    assert {r["evidence_id"]: r["display_text"] for r in evidence.citation_labels(src).collect()} == {"e": "Method; Method, Equation 3", "f": "d"}


TEX = r"""\documentclass{x}\title{T}\begin{document}
\section{Introduction}
Sequence modeling is a task. % hidden
\begin{figure}\includegraphics[width=3cm]{fig/a}\caption{A \textbf{figure}}\label{f:a}\end{figure}
\section{Model Architecture}
\subsection{Attention}
An attention function maps queries \cite{x}.
\begin{equation}\label{eq:1} a = b \end{equation}
\subsubsection{Deep}
\section{Experiments}
\subsubsection{Skipped level}
We train on two data sets here.
\end{document}"""


def test_parse(spark):
    t = spark.createDataFrame([("p", TEX)], "paper_id string, text string")
    s = {r["title"]: (r["level"], r["parent"]) for r in parse.sections(t).collect()}
    assert s == {"Introduction": (1, None), "Model Architecture": (1, None), "Attention": (2, "sec_tex_002"), "Deep": (3, "sec_tex_003"), "Experiments": (1, None), "Skipped level": (3, None)}
    f = parse.figures(t).first()
    assert (f["file"], f["caption"], f["label"]) == ("fig/a", "A figure", "f:a")
    assert [(r["equation_id"], r["label"], r["latex"]) for r in parse.equations(t).collect()] == [("eq_001", "eq:1", "a = b")]
    assert [(r["text"], r["section_id"]) for r in parse.paragraphs(t).orderBy("paragraph_id").collect()] == [("Sequence modeling is a task.", "sec_tex_001"), ("An attention function maps queries .", "sec_tex_003"), ("We train on two data sets here.", "sec_tex_006")]
    p = spark.createDataFrame([("p", 1, "Intro Part\nsome text goes on.\n\n"), ("p", 2, "more text, here.\n2 Next Part\nlast line.")], "paper_id string, page int, text string")
    assert [(r["text"], r["section_id"]) for r in parse.page_lines(p).where("NOT heading").orderBy("page", "pos").collect()] == [("some text goes on.", "sec_pdf_001"), ("more text, here.", "sec_pdf_001"), ("last line.", "sec_pdf_002")]


def zipped(members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in members.items():
            z.writestr(k, v)
    return bytearray(b.getvalue())


def test_archives(spark):
    good = zipped({"sub/other.tex": "x", "main.tex": r"\documentclass{a}\begin{document}\input{sec/one}\end{document}", "sec/one.tex": "One.", "fig/a.png": "p"})
    d = spark.createDataFrame([("a.zip", good), ("b.ZIP", zipped({"ok.tex": "x", "../evil.tex": "y"})), ("c.zip", bytearray(b"junk")), ("d.txt", bytearray(b""))], "path string, content binary")
    m = files.archive_members(d).cache()
    assert {(r["path"], r["problem"]) for r in m.where("problem IS NOT NULL").collect()} == {("b.ZIP", "unsafe member"), ("c.zip", "unreadable: BadZipFile")}
    ok = m.where("problem IS NULL")
    assert files.main_tex(ok).first()["member"] == "main.tex"
    assert "One." in files.expanded(ok).first()["text"]
    refs = spark.createDataFrame([("a.zip", "main.tex", "fig/a"), ("a.zip", "main.tex", "no")], "path string, main string, ref string")
    assert {r["ref"]: r["member"] for r in files.resolve_graphics(refs, ok).collect()} == {"fig/a": "fig/a.png", "no": None}


def test_strict_json(spark, tmp_path):
    schema = StructType([StructField("id", LongType()), StructField("name", StringType())])
    (tmp_path / "ok.json").write_text(json.dumps({"id": 1, "name": "x"}, indent=1))
    assert files.read_artifacts(spark, str(tmp_path / "ok.json"), schema).first()["name"] == "x"
    (tmp_path / "bad.json").write_text('{"id": 1, "extra": 2}')
    with pytest.raises(files.ArtifactError):
        files.read_artifacts(spark, str(tmp_path / "bad.json"), schema)
    rows = files.manifest(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and all(len(r["sha256"]) == 64 for r in rows)


def test_slide_package(spark, deck):
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    sp = lambda t, x, y, cx, cy, sz: f'<p:sp><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm></p:spPr><a:r><a:rPr sz="{sz}"/><a:t>{t}</a:t></a:r></p:sp>'
    deck_file = zipped({f"ppt/slides/slide{k}.xml": f"<p:sld {ns}>{body}</p:sld>" for k, body in {10: sp("out", -5, 0, 100, 100, 1200), 2: sp("one", 0, 0, 900000, 900000, 600) + sp("two", 10, 10, 900000, 900000, 1800), 1: ""}.items()})
    b = files.slide_boxes(spark.createDataFrame([("d.pptx", deck_file)], "path string, content binary")).where("i IS NOT NULL").withColumn("paper_id", F.lit("p")).withColumn("slide_id", F.concat(F.lit("s"), "slide"))
    got = {(r["code"], r["slide_ids"][0]) for r in qa.text_box_findings(b, 12192000, 6858000).collect()}
    assert got == {("OUT_OF_BOUNDS_TEXT", "s3"), ("UNREADABLY_SMALL_FONT", "s2"), ("TEXT_BOX_OVERLAP", "s2")}


def test_layout(spark):
    assert layout.layout_boxes(spark).count() == 48


def test_relations(spark):
    e = spark.createDataFrame([(1, "b c"), (2, "two three four five six seven eight"), (3, "X")], "excerpt_id int, excerpt string")
    t = spark.createDataFrame([(1, "a B  c d"), (2, "one two three four\nfive six seven eight nine")], "source_id int, text string")
    assert {tuple(r) for r in relations.contained(e, t).collect()} == {(1, 1), (2, 2), (3, 2)}
    d = spark.createDataFrame([("k", 1, "old"), ("j", 2, "x"), ("k", 3, "new")], "key string, n int, v string")
    assert {(r["key"], r["v"], r["position"]) for r in relations.choose_latest(d, "key", "n").collect()} == {("k", "new", 1), ("j", "x", 2)}


def test_short_excerpts_are_found(spark):
    """Excerpts of one to many words, and of under three characters, against a plain search."""
    excerpts = ["a", "of", "cat", "e ca", "the cat", "the cat sat", "cat sat on the mat", "the cat sat on the mat and slept well", "nowhere", "", "THE  Cat"]
    texts = ["The cat sat on the mat and slept well.", "Concatenate the  CAT, sat", "x", "", None, "ab cd ef", "a"]
    e = spark.createDataFrame(list(enumerate(excerpts)), "excerpt_id long, excerpt string")
    t = spark.createDataFrame(list(enumerate(texts)), "source_id long, text string")
    norm = lambda x: " ".join(x.split()).lower()
    want = {(i, j) for i, x in enumerate(excerpts) for j, y in enumerate(texts) if y is not None and norm(x) in norm(y)}
    got = [(r["excerpt_id"], r["source_id"]) for r in relations.contained(e, t).collect()]
    assert set(got) == want and len(got) == len(want)
    assert relations.contained(e.where("excerpt_id = 6"), t).collect() and relations.contained(e.limit(0), t).count() == 0


def test_limitations_survive_a_budget(spark):
    """A limitations unit of low importance is required, and counts in the narrative minimum."""
    rows = [("p", f"u{k}", k, r, i, 60) for k, (r, i) in enumerate([("problem", 5), ("core_insight", 5), ("method_overview", 5), ("experiments", 5), ("analysis", 4), ("limitations", 1), ("conclusion", 3)], 1)]
    u = spark.createDataFrame(rows, "paper_id string, unit_id string, `order` int, role string, importance int, seconds int")
    g = F.coalesce(*[F.when(F.col("role").isin(*roles), F.lit(k)) for k, roles in enumerate(planning.ROLE_GROUPS)])
    r = planning.required_units(u.withColumn("g", g), "paper_id", "g", "importance", "order")
    assert {x["unit_id"] for x in planning.select_within_budget(r, "paper_id", "unit_id", "importance", "order", "seconds", F.lit(360)).collect()} == {"u1", "u2", "u3", "u4", "u6", "u7"}
    assert [x["minimum"] for x in planning.narrative_minimum(r, "paper_id", "seconds", F.lit(350)).collect()] == [360]


def test_last_citation_wins_and_actions(deck):
    cited = deck["citations"].withColumn("pos", F.lit(0))
    both = cited.unionByName(cited.where("slide_id = 's2'").withColumn("source_ids", F.array(F.lit("other"))).withColumn("pos", F.lit(1)))
    found = qa.factual(deck["slides"], both, deck["visuals"], deck["nodes"], deck["known"]).collect()
    assert [(r["code"], r["slide_ids"], r["repairability"]) for r in found] == [("CITATION_SOURCE_MISMATCH", ["s2"], "none")] and found[0]["suggested_action"] == qa.ACTIONS["CITATION_SOURCE_MISMATCH"][1]
    assert not qa.factual(deck["slides"], both.withColumn("pos", -F.col("pos")), deck["visuals"], deck["nodes"], deck["known"]).collect()


def test_factual_tables_are_shuffled_once(spark, deck):
    """Findings on evidence, citations, numbers and visuals meet within their paper: one shuffle of all tables, by paper; rows that repeat a slide's id share findings on its evidence."""
    found = qa.factual(deck["slides"], deck["citations"], deck["visuals"], deck["nodes"], deck["known"])
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    twice = deck["slides"].unionByName(deck["slides"].where("slide_id = 's1'")).withColumn("takeaway", F.lit("99"))
    found = qa.factual(twice, deck["citations"].where("slide_id <> 's1'"), deck["visuals"], deck["nodes"], deck["known"].where("false")).groupBy("code", "slide_ids").count().collect()
    assert sorted((r["code"], *r["slide_ids"], r["count"]) for r in found) == [("MISSING_CITATION", "s1", 1), ("UNKNOWN_SOURCE_ASSET", "s1", 2), ("UNSUPPORTED_NUMBER", "s1", 2), ("UNSUPPORTED_NUMBER", "s2", 1), ("UNSUPPORTED_NUMBER", "s3", 1)]


def test_factual_rows_are_lean(spark, deck):
    """Evidence and files meet what names them in one window and a slide's rows in another, not in a hash table of lists that falls back to sorting, twice."""
    plan = qa.factual(deck["slides"], deck["citations"], deck["visuals"], deck["nodes"], deck["known"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 2 and "ObjectHashAggregate" not in plan


def test_factual_by_partitions(spark, deck):
    """Tables that lie by paper in as many partitions as asked for are not shuffled again, and findings are the same."""
    one = {k: v.repartition(7, "paper_id") for k, v in deck.items()}
    parts = [one[k] for k in ("slides", "citations", "visuals", "nodes")]
    found = qa.factual(*parts, one["known"].where("false"), partitions=7)
    assert found.rdd.getNumPartitions() == 7 and [(r["code"], r["slide_ids"], r["source_ids"]) for r in found.collect()] == [("UNKNOWN_SOURCE_ASSET", ["s1"], ["a1"])]


def test_deck_factual_bounds_the_lines_of_a_task(spark, monkeypatch):
    """A line is a few bytes of a shuffle and eight rows of a deck: tasks follow the number of lines, whatever the size in bytes and the setting; findings do not depend on them."""
    of, sf = queries_flows.deck_factual, "/root/testdata/sf0.001"
    few = of(spark, sf)
    monkeypatch.setattr(queries_flows, "LINES_A_TASK", 500, raising=False)
    many = of(spark, sf)
    assert many.where("code <> 'PAPER_ID_MISMATCH'").rdd.getNumPartitions() >= spark.read.parquet(f"{sf}/lineitem.parquet").count() / 500
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
