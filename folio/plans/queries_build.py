"""Queries over what a build reads and leaves: titles and formulas of made-up papers, elements and notes of slides, assets, options, steps, guards and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import formulas
from ..operators import elements as E
from ..operators import guards as G
from ..operators import incremental as I
from ..operators import parse as P
from ..operators.layout import LAYOUTS
from ..sources.files import classified_assets
from .queries_decks import _X, _lines, _t, _text

NAMES = [*LAYOUTS, "unheard_of"]


def paper_metadata(spark, d):
    """Parts as papers whose titles use two macros, one a beginning of the other, defined twice; every fifth has no title."""
    p = _t(spark, d, "part")
    macros = _text(r"\newcommand{\br}{old}\newcommand*{\br}{", F.col("p_brand"), r"} \newcommand\brand{", F.col("p_type"), "}")
    title = F.when(F.col("p_partkey") % 5 == 0, "").otherwise(_text(r"\title{", F.col("p_name"), "\n by " r"\brand{} and \br: \textbf{x} \vspace{2pt}}"))
    rest = _text(r"\author{A", F.col("p_partkey"), r" \and B; C}\begin{abstract} of \cite{k} ", F.col("p_name"), "  text % note\n" r"\end{abstract}")
    m = P.metadata(p.select(F.col("p_partkey").alias("paper_id"), F.concat(macros, title, rest).alias("text")))
    return m.select(F.col("paper_id").alias("p_partkey"), "title", F.array_join("authors", "/").alias("authors"), "abstract")


def formula_texts(spark, d):
    """Four forms of formula with the size and the key of each part in it."""
    p, n, k = _t(spark, d, "part"), F.col("p_size"), F.col("p_partkey")
    forms = (
        _text(r"\frac{", n, r"}{\sqrt{x_{i+1}}} \leq \hat a^{-2} % ", k),
        _text(r"\begin{aligned} y_{\text{max}} &= \tfrac12 \left( ", k, r" \right)^", n % 10, r" \\ z \in \mathcal A \end{aligned}"),
        _text(r"\sum_{i=1}^{n} \bar{o} + \frac{\frac{", n, r"}{2}}{\alpha_", k % 10, r"} \unknown ,"),
        _text(r"\sqrt{", n, r" \| \dot{q}", r"\label{eq:", k, r"} 5\% \{x\}"),
    )
    chosen = F.coalesce(*[F.when(k % 4 == i, f) for i, f in enumerate(forms)])
    return p.select("p_partkey", formulas.readable(chosen).alias("text"))


def _summary(elements, place=lambda c: F.round(F.sum(c) * 1e9).cast("long")):
    """One row a slide: how many elements, their texts and cells in order, and sums of their places: in whole thousand-millionths, or as `place` says."""
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("z", F.col(c).alias("v")))), lambda e: e["v"]), "|")
    sums = [place(c).alias(f"sum_{c}") for c in "xywh"]
    e = elements.withColumn("grid", F.array_join(F.flatten("cells"), ","))
    return e.groupBy("paper_id", "slide_id").agg(F.count("*").alias("n"), ordered("text").alias("texts"), ordered("grid").alias("grids"), F.round(F.coalesce(F.sum("font"), F.lit(0.0)) * 1000).cast("long").alias("fonts"), *sums)


def _named(df):
    return df.withColumnRenamed("paper_id", "l_orderkey")


def slide_frames(spark, d):
    """Frames of the slides that order lines are."""
    p, s, q = (F.col(c) for c in "psq")
    slides = _lines(spark, d).select("paper_id", "slide_id", F.col("order").alias("number"), _text("part ", p).alias("section"), F.when(q % 3 == 0, _text("tech", s)).alias("technical_title"), _text("t", p).alias("title"), F.when(q % 4 != 0, _text("k", s)).alias("takeaway"), F.when(q % 5 != 0, F.array(_text("c", p), _text("c", s))).alias("citations"))
    return _named(_summary(E.frame(slides)))


def body_lines(spark, d):
    """Bodies of one to five lines in every layout, and in one that is not known."""
    p, q = F.col("p"), F.col("q")
    body = F.transform(F.sequence(F.lit(1), 1 + q % 5), lambda i: _text("l", i))
    layout = F.element_at(F.array(*map(F.lit, NAMES)), (p % len(NAMES) + 1).cast("int"))
    slides = _lines(spark, d).select("paper_id", "slide_id", _text("claim", F.col("s")).alias("main_claim"), body.alias("body"), layout.alias("layout"))
    return _named(_summary(E.body(slides)))


def visual_elements(spark, d):
    """Orders as slides, their lines as the visuals on them, of all four kinds. Places are quotients of sizes: their sums stay doubles, since a rounded sum would hang on the order of adding."""
    p, s, q = (F.col(c) for c in "psq")
    x = _lines(spark, d)
    body = F.transform(F.sequence(F.lit(1), 1 + F.col("o_orderkey") % 5), lambda i: _text("l", i))
    layout = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("o_orderkey") % len(NAMES) + 1).cast("int"))
    slides = _t(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), F.lit("s").alias("slide_id"), body.alias("body"), layout.alias("layout"))
    kinds = F.array(*map(F.lit, ("source_asset", "source_table", "source_equation", "diagram")))
    cells = F.transform(F.sequence(F.lit(1), 1 + q % 12), lambda i: F.concat(F.array(i.cast("string")), F.array_repeat(F.lit("x"), (s % 6).cast("int"))))
    visuals = x.select(
        "paper_id", F.lit("s").alias("slide_id"), (F.col("order") - 1).alias("pos"), F.element_at(kinds, (q % 4 + 1).cast("int")).alias("kind"), _text("r", p).alias("source_ref"), F.when(p % 2 == 1, _text("cap", p)).alias("caption"),
        F.when(s % 2 == 0, "highlight").otherwise("full").alias("treatment"), F.when(s % 3 == 0, F.array(_text("n", s))).otherwise(F.array().cast("array<string>")).alias("annotations"), F.lit(None).cast("array<string>").alias("column_labels"),
        (p % 500 + 100).alias("image_w"), (s % 300 + 100).alias("image_h"), cells.alias("cells"), _text("f", p).alias("formula"), F.col("n").alias("formula_number"),
    )
    return _named(_summary(E.pictures(slides, visuals), F.sum)).drop("slide_id")


def note_blocks(spark, d):
    """The notes of each turn of a conversation."""
    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("paper_id"), F.col("turn").alias("slide_id"), F.lit("why").alias("notes_purpose"), F.col("role").alias("notes_message"), F.col("text").alias("notes_script"), F.when(F.col("turn") > 0, "look").alias("notes_guidance"), F.lit("next").alias("notes_transition"), F.length("text").alias("notes_seconds"), F.array(F.col("role"), F.lit("b")).alias("citations"))
    return E.note_texts(c).select(F.col("paper_id").alias("conv_id"), F.col("slide_id").alias("turn"), F.sha2("notes", 256).alias("digest"), F.length("notes").alias("n_chars"))


def asset_order(spark, d):
    """Documents as graphics of their source; their ids give the endings, and whether they were embedded."""
    endings = F.array(*map(F.lit, (".pdf", ".PNG", ".svg", ".jpeg", ".Eps", "", ".xyz")))
    a = _t(spark, d, "documents").select(F.col("source").alias("paper_id"), F.format_string("asset_%010d", F.col("doc_id")).alias("asset_id"), F.concat(F.lit("v1.2/f"), F.element_at(endings, (F.col("doc_id") % 7 + 1).cast("int"))).alias("file"), (F.col("doc_id") % 11 == 0).alias("embedded"))
    return classified_assets(a).select(F.col("paper_id").alias("source"), "asset_id", "origin", "priority", "media_type", "rank")


def build_resumption(spark, d):
    """Orders as builds: which steps run when some have lost files, changed their inputs, or are resumed from a step."""
    k = F.col("o_orderkey")
    runs = _t(spark, d, "orders").select(k.alias("run_id"), F.lit("now").alias("fingerprint"))
    steps = F.array(*map(F.lit, I.STEPS))
    every = runs.select("run_id", F.posexplode(steps).alias("pos", "step"))
    old = every.select("run_id", "step", F.when(F.col("pos") <= F.col("run_id") % 9, "completed").otherwise("pending").alias("status"), F.when(F.col("run_id") % 7 == 0, "then").otherwise("now").alias("fingerprint"))
    left = runs.select("run_id").join(F.broadcast(I.steps_frame(spark)), F.lit(True)).where("NOT (run_id % 5 = 0 AND step = 'plan')")
    lost = I.missing_artifacts(runs, left)
    start = runs.where(F.col("run_id") % 4 == 0).select("run_id", F.element_at(steps, (F.col("run_id") % 6 + 2).cast("int")).alias("resume_from"))
    again, problems = I.resumed(old, lost, start)
    bad = problems.groupBy("run_id").agg(F.count("*").alias("n_lost"))
    todo = I.to_do(again, lost, runs).groupBy("run_id").agg(F.count_if(F.col("action") == "run").alias("n_run"), F.min(F.when(F.col("action") == "run", F.col("pos"))).alias("first_run"))
    return todo.join(bad.hint("merge"), "run_id", "left").select(F.col("run_id").alias("o_orderkey"), "n_run", "first_run", F.coalesce("n_lost", F.lit(0)).cast("long").alias("n_lost"))


def evidence_guard(spark, d):
    """Decks in which a change of evidence, citation or visual slipped in beside a harmless one of the title."""
    x, p, s = _lines(spark, d), F.col("p"), F.col("s")
    one = lambda changed: x.select("paper_id", "slide_id", "order", _text("t", F.when(F.lit(changed), p + 1).otherwise(p)).alias("title"), F.array(_text("e", p + F.when(F.lit(changed) & (p % 31 == 0), 1).otherwise(0)), _text("e", s)).alias("evidence_ids"))
    cited = lambda changed: x.select("paper_id", "slide_id", F.lit(0).alias("pos"), _text("c", s + F.when(F.lit(changed) & (s % 37 == 0), 1).otherwise(0)).alias("display"))
    seen = lambda changed: x.where("q % 2 = 0").select("paper_id", "slide_id", F.lit(0).alias("pos"), F.lit("source_table").alias("kind"), _text("t", p).alias("source_ref"), F.when(F.lit(changed) & (p % 41 == 0), "crop").otherwise("full").alias("treatment"))
    before, after = (G.evidence_signatures(one(c), seen(c), cited(c)) for c in (False, True))
    return G.changed_evidence(before, after).select(F.col("paper_id").alias("l_orderkey"))


def canonical_rows(spark, d):
    """Suppliers as JSON with sorted keys, whatever the order of columns and inner fields."""
    s = _t(spark, d, "supplier").select(F.struct(F.col("s_suppkey").alias("z"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey")).alias("b")).alias("inner"), "s_name", F.array(F.struct(F.col("s_nationkey").alias("y"), F.col("s_suppkey").alias("a"))).alias("list"), "s_suppkey")
    return s.select("s_suppkey", G.canonical_json(s, "s_name", "inner", "list").alias("text"))


def build_options(spark, d):
    """Orders as calls of a build: what is wrong with their options."""
    k = F.col("o_orderkey")
    o = _t(spark, d, "orders").select(k.alias("run_id"), F.when(k % 3 == 0, "conference-minimal").when(k % 3 == 1, "group-meeting").when(k % 2 == 0, "dark").alias("theme"), F.when(k % 5 == 0, "spec").when(k % 5 == 1, "draw").alias("resume_from"), (k % 2 == 0).alias("semantic_qa"), (k % 4 == 0).alias("has_provider"))
    return G.option_problems(o).withColumnRenamed("run_id", "o_orderkey")


def draft_contexts(spark, d):
    """Regions as papers, with their nations and the names of their nations' suppliers."""
    r = _t(spark, d, "region").select(F.col("r_regionkey").alias("paper_id"), F.col("r_name").alias("title"))
    n = _t(spark, d, "nation").select(F.col("n_regionkey").alias("paper_id"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 2 == 0, "even").alias("kind"))
    return G.draft_contexts(r, nations=n).select(F.col("paper_id").alias("r_regionkey"), "context")


_ALL = (paper_metadata, formula_texts, slide_frames, body_lines, visual_elements, note_blocks, asset_order, build_resumption, evidence_guard, canonical_rows, build_options, draft_contexts)
QUERIES = {f.__name__: f for f in _ALL}

_LAYOUT_NAMES = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
_BOXES = ", ".join(f"('{n}', {', '.join(f'{v}::DOUBLE' for v in (*LAYOUTS.get(n, LAYOUTS['minimal_text'])['text'], *LAYOUTS.get(n, LAYOUTS['minimal_text'])['visual']))})" for n in NAMES)
_B = f"b(layout, tx, ty, tw, th, vx, vy, vw, vh) AS (VALUES {_BOXES})"
_BIG = "CAST(round({} * 1e9) AS BIGINT) AS sum_{}"
ORACLES = {
    "paper_metadata": r"""SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_name || ' by ' || p_type || ' and ' || p_brand || ': x' END AS title, 'A' || p_partkey || '/B/C' AS authors, 'of ' || p_name || ' text' AS abstract FROM part""",
    "formula_texts": r"""SELECT p_partkey, CASE p_partkey % 4
 WHEN 0 THEN '(' || p_size || ')/(√(xᵢ₊₁)) ≤ â⁻²'
 WHEN 1 THEN 'y_max = (1)/(2) ( ' || p_partkey || ')' || substr('⁰¹²³⁴⁵⁶⁷⁸⁹', p_size % 10 + 1, 1) || ' z ∈ A'
 WHEN 2 THEN 'Σᵢ₌₁^n ō + ((' || p_size || ')/(2))/(α' || substr('₀₁₂₃₄₅₆₇₈₉', p_partkey % 10 + 1, 1) || ') \unknown,'
 ELSE '\sqrt' || p_size || ' ‖ q' || chr(775) || ' 5% x' END AS text FROM part""",
    "slide_frames": f"""WITH {_X}, f AS (SELECT *, CASE WHEN q % 3 = 0 THEN 1 ELSE 0 END AS t FROM x)
SELECT l_orderkey, 's' || o AS slide_id, 8 + t AS n, concat_ws('|', 'PART ' || p, CASE WHEN t = 1 THEN 'tech' || s END, 't' || p, CASE WHEN q % 4 <> 0 THEN 'k' || s ELSE '' END, CASE WHEN q % 5 <> 0 THEN 'c' || p || ' · c' || s ELSE '' END, CASE WHEN o < 10 THEN '0' ELSE '' END || o) AS texts, '' AS grids,
 CAST((10 + 29 + 17 + 10 + 9 + 11 * t) * 1000 AS BIGINT) AS fonts, {_BIG.format('(0.72 * 6 + 0.92 + 12.35 + 8.6 * t)', 'x')}, {_BIG.format('(0.2 + 0.56 + 1.38 + 6.43 + 6.43 + 6.49 + 7.08 + 7.04 + 0.2 * t)', 'y')},
 {_BIG.format('(3.7 + 11.9 * 4 + 0.08 + 11.5 + 0.28 + 3.85 * t)', 'w')}, {_BIG.format('(0.25 + 0.75 + 0.55 * 2 + 0.43 + 0.2 * 2 + 0.25 * t)', 'h')} FROM f""",
    "body_lines": f"""WITH {_X}, {_B}, l AS (SELECT l_orderkey, o, s, b.*, 1 + q % 5 AS n, CASE WHEN layout IN ('minimal_text', 'unheard_of') THEN 1 ELSE 0 END AS alone FROM x JOIN b ON layout = {_LAYOUT_NAMES}[p % {len(NAMES)} + 1] WHERE layout <> 'table_focus'),
m AS (SELECT *, ty + alone * least(1.7, th * 0.42) AS start FROM l), g AS (SELECT *, th - (start - ty) AS room, least(0.2, (th - (start - ty)) * 0.06) AS gap FROM m), h AS (SELECT *, least(0.82, (room - gap * (n - 1)) / n) AS high FROM g)
SELECT l_orderkey, 's' || o AS slide_id, 2 * n + alone AS n, CASE WHEN alone = 1 THEN 'claim' || s || '|' ELSE '' END || array_to_string(list_transform(range(1, n + 1), lambda i: 'l' || i), '|') AS texts, '' AS grids, CAST((19 * n + 25 * alone) * 1000 AS BIGINT) AS fonts,
 {_BIG.format('(n * (2 * tx + 0.32) + alone * tx)', 'x')}, {_BIG.format('(n * (2 * start + 0.12) + (high + gap) * n * (n - 1) + alone * ty)', 'y')}, {_BIG.format('(n * (0.18 + tw - 0.32) + alone * tw)', 'w')}, {_BIG.format('(n * high + alone * least(1.5, th * 0.38))', 'h')} FROM h""",
    "visual_elements": f"""WITH {_X}, {_B}, v AS (SELECT x.*, vx, vw, count(*) OVER (PARTITION BY l_orderkey) AS nv, vy, vh, 1 + l_orderkey % 5 AS nb, q % 4 AS kind, CASE WHEN p % 2 = 1 THEN 1 ELSE 0 END AS cap, CASE WHEN s % 3 = 0 AND q % 4 <> 1 THEN 1 ELSE 0 END AS note,
  1 + q % 12 AS nr, 1 + s % 6 AS nc FROM x JOIN b ON layout = {_LAYOUT_NAMES}[l_orderkey % {len(NAMES)} + 1] WHERE layout NOT IN ('minimal_text', 'unheard_of')),
w AS (SELECT *, (vh - 0.18 * (nv - 1)) / nv AS h, vx AS x0, vw AS w0, least(nb, 4) AS k FROM v), y AS (SELECT *, vy + (o - 1) * (h + 0.18) AS y0, (w0 - 0.24 * (k - 1)) / k AS wide, s % 2 = 0 AND nr > 8 AS short,
  least((w0 - 0.24) / (p % 500 + 100), (h - CASE WHEN cap = 1 THEN 0.52 ELSE 0.24 END) / (s % 300 + 100)) AS scale FROM w),
z AS (SELECT *, (p % 500 + 100) * scale AS iw, (s % 300 + 100) * scale AS ih, CASE WHEN short THEN 7 ELSE nr END AS shown FROM y),
e AS (SELECT l_orderkey, o,
 1 + 2 * note + CASE kind WHEN 0 THEN 1 + cap WHEN 1 THEN 1 + cap WHEN 2 THEN 2 ELSE 2 * k END AS n,
 concat_ws('|', CASE kind WHEN 0 THEN 'r' || p WHEN 1 THEN 'r' || p WHEN 2 THEN 'f' || p ELSE array_to_string(list_transform(range(1, k + 1), lambda i: 'l' || i), '|') END, CASE WHEN kind < 3 AND cap = 1 THEN 'cap' || p WHEN kind = 2 THEN 'Equation ' || n END, CASE WHEN note = 1 THEN 'n' || s END) AS texts,
 CASE WHEN kind = 1 THEN CASE WHEN short THEN array_to_string(list_transform([1, 2], lambda i: i || repeat(',x', nc - 1)), ',') || ',…' || repeat(',', nc - 1) || ',' || array_to_string(list_transform(range(nr - 3, nr + 1), lambda i: i || repeat(',x', nc - 1)), ',')
   ELSE array_to_string(list_transform(range(1, nr + 1), lambda i: i || repeat(',x', nc - 1)), ',') END END AS grid,
 9.5 * note + CASE kind WHEN 0 THEN 9.5 * cap WHEN 1 THEN 9.5 * cap + greatest(8, least(13, 13 - greatest(0, shown - 5) * 0.35 - greatest(0, nc - 4) * 0.4)) WHEN 2 THEN 36.5 ELSE 17 * k END AS font,
 x0 + note * (2 * x0 + 0.8) + CASE kind WHEN 0 THEN x0 + 0.12 + (w0 - 0.24 - iw) / 2 + cap * (x0 + 0.18) WHEN 1 THEN (1 + cap) * (x0 + 0.25) WHEN 2 THEN 2 * (x0 + 0.35) ELSE k * (2 * x0 + 0.12) + (wide + 0.24) * k * (k - 1) END AS x,
 y0 + note * (2 * y0 + 0.23) + CASE kind WHEN 0 THEN y0 + 0.12 + (h - CASE WHEN cap = 1 THEN 0.52 ELSE 0.24 END - ih) / 2 + cap * (y0 + h - 0.32) WHEN 1 THEN y0 + 0.3 + cap * (y0 + h - 0.28) WHEN 2 THEN 2 * y0 + h + 0.05 ELSE k * (2 * (y0 + h * 0.25) + 0.12) END AS y,
 w0 + note * (w0 - 0.47) + CASE kind WHEN 0 THEN iw + cap * (w0 - 0.36) WHEN 1 THEN (1 + cap) * (w0 - 0.5) WHEN 2 THEN 2 * (w0 - 0.7) ELSE k * (2 * wide - 0.24) END AS w,
 h + note * 0.28 + CASE kind WHEN 0 THEN ih + cap * 0.22 WHEN 1 THEN h - 1.0 + cap * 0.2 WHEN 2 THEN h - 0.52 ELSE k * (h - 0.24) END AS h FROM z)
SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS n, string_agg(nullif(texts, ''), '|' ORDER BY o) AS texts, coalesce(string_agg(grid, '|' ORDER BY o), '') AS grids, CAST(round(sum(font) * 1000) AS BIGINT) AS fonts, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS sum_{c}' for c in 'xywh')} FROM e GROUP BY l_orderkey""",
    "note_blocks": """WITH n AS (SELECT conv_id, turn, 'Purpose: why' || chr(10) || chr(10) || 'Main Message: ' || role || chr(10) || chr(10) || 'Speaking Script: ' || text || chr(10) || chr(10) || 'Visual Guidance: ' || CASE WHEN turn > 0 THEN 'look' ELSE '' END || chr(10) || chr(10) || 'Transition: next' || chr(10) || chr(10)
 || 'Estimated Time: ' || length(text) || ' seconds' || chr(10) || chr(10) || 'Sources: ' || role || '; b' AS notes FROM conversations) SELECT conv_id, turn, sha256(notes) AS digest, CAST(length(notes) AS INTEGER) AS n_chars FROM n""",
    "asset_order": """WITH a AS (SELECT source, 'asset_' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS asset_id, doc_id % 7 AS e, CASE WHEN doc_id % 11 = 0 THEN 3 WHEN doc_id % 7 IN (0, 2, 4) THEN 1 ELSE 2 END AS priority FROM documents)
SELECT source, asset_id, ['latex_vector', 'latex_raster', 'pdf_embedded'][priority] AS origin, priority, ['application/pdf', 'image/png', 'image/svg+xml', 'image/jpeg', 'application/postscript', NULL, NULL][e + 1] AS media_type, CAST(row_number() OVER (PARTITION BY source ORDER BY priority, asset_id) AS INTEGER) AS rank FROM a""",
    "build_resumption": """WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 6 + 1 END AS start FROM orders), s AS (SELECT k, start, unnest(range(7)) AS pos FROM r),
ok AS (SELECT k, pos, start, CASE WHEN start IS NULL THEN pos <= k % 9 ELSE pos < start END AND k % 7 <> 0 AND NOT (pos = 2 AND k % 5 = 0) AS fine FROM s), f AS (SELECT k, start, coalesce(min(pos) FILTER (NOT fine), 7) AS first FROM ok GROUP BY k, start)
SELECT k AS o_orderkey, CAST(7 - first AS BIGINT) AS n_run, CAST(nullif(first, 7) AS INTEGER) AS first_run, CAST(CASE WHEN k % 5 = 0 AND start > 2 THEN 2 ELSE 0 END AS BIGINT) AS n_lost FROM f""",
    "evidence_guard": f"""WITH {_X} SELECT DISTINCT l_orderkey FROM x WHERE p % 31 = 0 OR s % 37 = 0 OR (p % 41 = 0 AND q % 2 = 0)""",
    "canonical_rows": """SELECT s_suppkey, '{"inner":{"b":' || CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_nationkey AS VARCHAR) ELSE 'null' END || ',"z":' || s_suppkey || '},"list":[{"a":' || s_suppkey || ',"y":' || s_nationkey || '}],"s_name":' || to_json(s_name) || '}' AS text FROM supplier""",
    "build_options": """SELECT o_orderkey, 'theme must be conference-minimal or group-meeting' AS problem FROM orders WHERE o_orderkey % 3 = 2 UNION ALL SELECT o_orderkey, 'resume_from must be one of: parse, understand, plan, spec, render, qa, package' FROM orders WHERE o_orderkey % 5 = 1
UNION ALL SELECT o_orderkey, 'semantic_qa and its provider must be enabled together' FROM orders WHERE o_orderkey % 4 = 2""",
    "draft_contexts": """SELECT r_regionkey, '{"paper_id":' || r_regionkey || ',"title":' || to_json(r_name) || ',"nations":[' || coalesce((SELECT string_agg('{"name":' || to_json(n_name) || ',"kind":' || CASE WHEN n_nationkey % 2 = 0 THEN '"even"' ELSE 'null' END || '}', ',' ORDER BY n_nationkey) FROM nation WHERE n_regionkey = r_regionkey), '') || ']}' AS context FROM region""",
}
