"""Titles, formulas, sources, elements, guards, builds and the command line, on small artifacts."""

import json

import pytest

from folio import cli
from folio.functions import latex
from folio.functions.formulas import formula_text
from folio.operators import elements, guards, incremental, parse, qa
from folio.plans import flows
from folio.sources import files
from test_packages import NS, package


@pytest.mark.parametrize(
    ("tex", "text"),
    [
        (r"\frac{QK^{\top}}{\sqrt{d_k}} + x^{2} \leq 3", r"(QK^(\top))/(√(d_k)) + x² ≤ 3"),
        (r"\tfrac\beta2 + \hat z_t \in\mathcal A", "(β)/(2) + ẑ_t ∈ A"),
        (r"\sum_{i=1}^{n} x_{\text{max}} % gone", "Σᵢ₌₁^n x_max"),
        (r"\begin{aligned} a &= b \label{q} \\ c \end{aligned}", "a = b c"),
        (r"x_{t-1} e^{-x^{2}} \dot{q}", "xₜ₋₁ e^(-x²) q̇"),
        (r"\frac{a", r"\fraca"),
        ("{" * 500 + "x" + "}" * 500, "x"),
        ("", ""),
        (None, None),
    ],
)
def test_formulas(tex, text):
    assert formula_text(tex) == text


def test_includes_stay_in_the_tree():
    tree = {"m.tex": r"\input{./s/one} \input{a/../two.tikz} \input{gone}", "s/one.tex": r"1 \input{../m} \input{../three}", "two.tikz": "2", "three.tex": "3"}
    assert latex.expand_includes(tree, "m.tex") == r"1  3 2 \input{gone}"
    with pytest.raises(ValueError):
        latex.expand_includes({"s/m.tex": r"\input{../../x}"}, "s/m.tex")


def test_graphics_stay_in_the_archive(spark):
    refs = spark.createDataFrame([("z", "src/main.tex", r) for r in ("../fig/a", "./b.png", "../../x.png", "/b.png", "c")], "path string, main string, ref string")
    have = spark.createDataFrame([("z", m) for m in ("fig/a.png", "src/b.png", "x.png", "c.pdf", "c.png")], "path string, member string")
    got = files.resolve_graphics(refs, have)
    assert {r["ref"]: r["member"] for r in got.collect()} == {"../fig/a": "fig/a.png", "./b.png": "src/b.png", "../../x.png": None, "/b.png": None, "c": "c.pdf"}
    assert {r["ref"] for r in files.graphic_warnings(got).collect()} == {"../../x.png", "/b.png"}


def test_metadata(spark):
    tex = [("p", r"\newcommand{\sys}{A$1}\newcommand\sysx{B}\newcommand{\sys}{C}\title{On \sys{} and \sysx: \textbf{x}}\author{A B \and C; D}\begin{abstract} Hi \cite{z} there\end{abstract}"), ("q", None), ("r", r"\title{ }"), ("s", r"\newcommand{\d}{a\b$0}\title{x \d y}")]
    got = {r["paper_id"]: (r["title"], r["authors"], r["abstract"]) for r in parse.metadata(spark.createDataFrame(tex, "paper_id string, text string")).collect()}
    assert got["p"] == ("On C and B: x", ["A B", "C", "D"], "Hi there") and got["q"] == (None, [], None) == got["r"] and got["s"][0] == "x a$0 y"
    m = "paper_id string, title string, authors array<string>, abstract string"
    both = parse.merged_metadata(spark.createDataFrame([("p", "T", [], None)], m), spark.createDataFrame([("p", "U", ["x"], "a"), ("q", "V", None, None)], m))
    assert {tuple(map(str, r)) for r in both.collect()} == {("p", "T", "['x']", "a"), ("q", "V", "[]", "None")}


def deck_to_draw(spark):
    slides = [("p", "s1", 1, "intro", "tech", "T", "claim", ["a", "b"], "k", ["c1", "c2"], "visual_left_text_right"), ("p", "s2", 12, None, None, "U", "cl", ["b", "c", "d", "e", "f"], None, None, "process"), ("p", "s3", 3, "x", "", "V", "cl", [], "", [], "odd"), ("p", "s4", 4, "x", "", "V", "cl", None, "", [], "process")]
    s = spark.createDataFrame(slides, "paper_id string, slide_id string, number int, section string, technical_title string, title string, main_claim string, body array<string>, takeaway string, citations array<string>, layout string")
    visuals = [(k, kind, ref, cap) for k, (kind, ref, cap) in enumerate((("source_table", "t1", "cap"), ("source_asset", "a1", None), ("source_equation", "e1", None), ("diagram", "d", None)))]
    rows = [("p", "s1", k, kind, ref, cap, "highlight", ["n"], None, 100, 50, "3") for k, kind, ref, cap in visuals]
    v = spark.createDataFrame(rows, "paper_id string, slide_id string, pos int, kind string, source_ref string, caption string, treatment string, annotations array<string>, column_labels array<string>, image_w int, image_h int, formula_number string")
    tables = spark.createDataFrame([("p", "t1", r"\begin{tabular}{lc}" + r"\\".join(f"{i} & x" for i in range(10)) + r"\end{tabular}")], "paper_id string, table_id string, latex string")
    equations = spark.createDataFrame([("p", "e1", r"\frac12")], "paper_id string, equation_id string, latex string")
    notes = s.selectExpr("*", "'w' notes_purpose", "'m' notes_message", "'s' notes_script", "'g' notes_guidance", "'t' notes_transition", "30 notes_seconds")
    return notes, v, tables, equations


def test_render_deck(spark):
    s, v, tables, equations = deck_to_draw(spark)
    got = flows.render_deck(s, v, tables, equations)
    e = got["elements"].collect()
    of = lambda slide, kind: [r for r in e if r["slide_id"] == slide and r["kind"] == kind]
    assert [r["text"] for r in of("s1", "formula")] == ["(1)/(2)"] and of("s1", "caption")[0]["text"] in ("cap", "Equation 3")
    assert [r[0] for r in of("s1", "table")[0]["cells"]] == ["0", "1", "…", "6", "7", "8", "9"]
    assert len(of("s2", "step")) == 4 and len(of("s2", "line")) == 5 and len(of("s3", "line")) == 0 == len(of("s4", "step")) and len(of("s3", "claim")) == 1
    assert of("s2", "folio")[0]["text"] == "12" and not of("s2", "technical_title") and of("s1", "citation")[0]["text"] == "c1 · c2"
    p = of("s1", "picture")[0]
    assert abs(p["w"] / p["h"] - 2) < 1e-9 and len(of("s1", "annotation")) == 3
    note = {r["slide_id"]: r["notes"] for r in got["notes"].collect()}["s1"]
    assert note.split("\n\n")[0] == "Purpose: w" and note.endswith("Sources: c1; c2") and len(note.split("\n\n")) == 7
    assert {r["slide_id"] for r in flows.render_deck(s, v, tables, equations, [12])["elements"].select("slide_id").distinct().collect()} == {"s2"}
    with pytest.raises(flows.GateError):
        flows.render_deck(s, v, tables, equations, [99])


def test_labels_replace_the_first_row(spark):
    df = spark.createDataFrame([([["a", "b"], ["1", "2"]], "full", ["X", "Y"]), ([["a", "b"]], "full", ["X"]), (None, "highlight", None)], "cells array<array<string>>, t string, l array<string>")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(elements.shown_cells(F.col("cells"), F.col("t"), F.col("l"))).collect()] == [[["X", "Y"], ["1", "2"]], [["a", "b"]], None]


def test_theme():
    theme = {"name": "group-meeting", "fontFallbacks": ["A"]} | {k: "x" for k in guards.THEME_TEXTS}
    assert guards.read_theme(json.dumps(theme), "group-meeting", " F ")["fontFamily"] == "F"
    for bad in (theme | {"name": "other"}, theme | {"accent": " "}, theme | {"fontFallbacks": []}, []):
        with pytest.raises(ValueError):
            guards.read_theme(json.dumps(bad), "group-meeting")


def test_canonical_json_does_not_depend_on_order(spark):
    a, b = (spark.sql(f"SELECT {x}") for x in ("named_struct('b', 1, 'a', map('y', 2, 'x', CAST(NULL AS INT))) s, 3 k", "3 k, named_struct('a', map('x', CAST(NULL AS INT), 'y', 2), 'b', 1) s"))
    one, two = (df.select(guards.canonical_json(df)).first()[0] for df in (a, b))
    assert one == two == '{"k":3,"s":{"a":{"x":null,"y":2},"b":1}}'


def test_build_runs_what_is_left(spark):
    steps = incremental.STEPS
    wanted = spark.createDataFrame([("r", "f"), ("n", "g")], "run_id string, fingerprint string")
    state = spark.createDataFrame([("r", s, "completed", "f") for s in steps], "run_id string, step string, status string, fingerprint string")
    left = spark.createDataFrame([("r", a) for s in steps for a in incremental.EXPECTED[s]], "run_id string, artifact string")
    called = []
    handlers = {s: lambda ids, s=s: called.append((s, sorted(r[0] for r in ids.collect()))) for s in steps}
    assert flows.run_build(state, left, wanted, handlers) == [(s, "run") for s in steps] and called == [(s, ["n"]) for s in steps]
    mine = wanted.where("run_id = 'r'")
    assert flows.run_build(state, left, mine, handlers) == [(s, "skip") for s in steps]
    assert flows.run_build(state, left, mine, handlers, "spec") == [(s, "skip" if k < 3 else "run") for k, s in enumerate(steps)]
    with pytest.raises(flows.GateError):
        flows.run_build(state, left.where("artifact <> 'evidence_graph.json'"), mine, handlers, "spec")


def test_package_parts(spark):
    import io
    import zipfile

    wide = '<p:sldSz cx="12192000" cy="6858000"/>'
    whole = io.BytesIO(package(wide, "<a:tbl/>", "<a:t>y = a/b</a:t>"))
    with zipfile.ZipFile(whole, "a") as z:
        z.writestr("ppt/notesSlides/notesSlide1.xml", f"<p:n {NS}><a:t>Purpose: Main Message: Speaking Script:</a:t></p:n>")
        z.writestr("ppt/media/a.svg", "")
    d = spark.createDataFrame([("good", whole.getvalue()), ("bare", package(wide, "")), ("torn", b"PK")], "path string, content binary")
    parts = files.package_parts(d)
    got = {r["path"]: tuple(r)[1:-1] for r in parts.collect()}
    assert got["good"] == (2, 1, ["ppt/notesSlides/notesSlide1.xml Sources:"], 1, 1, True) and got["bare"] == (1, 0, [], 0, 0, False) and got["torn"] == (None,) * 6
    errors = {}
    for r in files.structure_errors(parts, 2, True, True, True, True).collect():
        errors.setdefault(r["path"], []).append(r["error"])
    assert errors["good"] == ["expected notes for every slide, found 1 for 2 slides", "ppt/notesSlides/notesSlide1.xml is missing Sources:"] and len(errors["bare"]) == 5 and len(errors["torn"]) == 1
    assert [r["reason"] for r in qa.render_failures(spark.createDataFrame([("p", "x")], "paper_id string, reason string")).selectExpr("message reason").collect()] == ["无法完成 PPTX → PDF → PNG：x"]
    types = '<Types><Override PartName="/ppt/slideMasters/slideMaster1.xml" ContentType="m"/><Override PartName="/ppt/slideMasters/slideMaster2.xml" ContentType="m"/></Types>'
    fixed, gone = files.safe_content_types(types, ["ppt/slideMasters/slideMaster1.xml"])
    assert gone == 1 and "slideMaster1" in fixed and "slideMaster2" not in fixed


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["version"]) == 0 and capsys.readouterr().out.strip() == cli.VERSION
    assert cli.main(["doctor"]) == 0 and json.loads(capsys.readouterr().out)["ready"]
    spark.createDataFrame([("p", r"\title{T}\section{One} text")], "paper_id string, text string").write.parquet(str(tmp_path / "in" / "tex.parquet"))
    where = ["--in", str(tmp_path / "in"), "--out", str(tmp_path / "out")]
    assert cli.main(["parse", *where], spark) == 0
    assert [r["title"] for r in spark.read.parquet(str(tmp_path / "out" / "sections")).collect()] == ["One"] and spark.read.parquet(str(tmp_path / "out" / "metadata")).first()["title"] == "T"
    assert cli.main(["qa", *where], spark) == 2


def test_tables_of_runs_are_not_broadcast(spark):
    from folio.plans.queries_build import build_resumption

    assert "BroadcastHashJoin" not in build_resumption(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_signatures_shuffle_lines_alone(spark):
    from folio.plans.queries_build import evidence_guard

    plan = evidence_guard(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and plan.count("Join ") + plan.count("Join[") <= 1
