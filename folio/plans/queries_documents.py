"""Queries over nested documents and drafts that are made of orders and their lines, with faults planted in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import elements as E
from ..operators import scope
from ..sinks import packages, staged
from ..sources import archives, files
from ..sources.shared import shared_path
from .queries_decks import _X, _lines, _t, _text

_FLAGS = ("preserve_source_visual_language", "translate_generic_labels", "translate_speaker_notes")


def _specs(x):
    """(paper_id, json): each order as a slide specification. Which faults it has follows from part, supplier, quantity and order."""
    p, s, q, at, k = (F.col(c) for c in ("p", "s", "q", "order", "paper_id"))
    one = lambda v: F.when(v, F.lit(1)).otherwise(0)
    visual = F.struct(
        _text("v", p).alias("visual_id"), _text("r", s).alias("source_ref"), F.when(p % 23 == 0, "photo").otherwise(F.element_at(F.array(*map(F.lit, D.SPEC_VISUALS)), (p % 4 + 1).cast("int"))).alias("kind"),
        F.when(q % 4 == 0, F.array(F.lit("a"), F.when(q % 8 == 0, "").otherwise("b"))).alias("table_column_labels"), F.when(p % 17 == 0, F.struct(F.lit(1).alias("x"))).alias("colour"),
    )
    seconds = F.when(s % 19 == 0, F.parse_json(F.lit('"ten"'))).otherwise(F.parse_json(q.cast("string")))
    notes = F.struct(*[F.lit("t").alias(c) for c in ("purpose", "main_message", "visual_guidance", "transition")], F.when(p % 13 == 0, " \n").otherwise("script").alias("script"), seconds.alias("estimated_seconds"), F.when(s % 29 == 0, "calm").alias("mood"))
    slide = F.struct(
        F.when((p % 31 == 0) & (at > 1), "s1").otherwise(_text("s", at)).alias("slide_id"), _text("u", at).alias("unit_id"), *[F.lit("t").alias(c) for c in ("section", "purpose", "question", "main_claim")],
        F.when(s % 11 == 0, " ").otherwise(_text("t", p)).alias("title"), F.when(s % 7 != 0, "k").alias("takeaway"), (at + one(q % 13 == 0)).alias("order"), F.lit("process").alias("layout"), F.array(F.lit("b")).alias("body"),
        F.when(q % 10 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("c"))).alias("citations"), F.array(visual).alias("visuals"), notes.alias("speaker_notes"),
    )
    slides = x.select("paper_id", at, q, F.to_json(slide).alias("slide")).groupBy("paper_id").agg(F.sum("q").alias("total"), F.array_sort(F.collect_list(F.struct("order", "slide"))).alias("slides"))
    shown = F.struct(F.lit("zh-CN").alias("language"), F.lit("bilingual").alias("terminology_mode"), *[(F.lit(True) if f != _FLAGS[1] else k % 10 != 0).alias(f) for f in _FLAGS])
    head = F.struct(
        F.lit("1.1").alias("schema_version"), _text("o", k).alias("paper_id"), F.when(k % 6 == 0, "dark").otherwise("group-meeting").alias("theme"), F.lit("t").alias("title"), F.lit("zh-CN").alias("language"),
        F.lit("zh_cn_bilingual_terms").alias("language_profile"), shown.alias("presentation"), (F.col("total") + one(k % 9 == 0)).alias("estimated_total_seconds"),
    )
    whole = F.concat(F.rtrim(F.to_json(head), F.lit("}")), F.lit(',"slides":['), F.array_join(F.transform("slides", lambda e: e["slide"]), ","), F.lit("]}"))
    return slides.select("paper_id", F.when(k % 101 == 0, "{").otherwise(whole).alias("json"))


def spec_documents(spark, d):
    """Problems of slide specifications, up to three levels deep: strange, lost, empty, mistyped and repeated fields."""
    return D.validate(_specs(_lines(spark, d)), D.slide_spec()).withColumnRenamed("paper_id", "l_orderkey")


def _drafts(spark, d):
    """(slides, evaluations, dependencies, nodes) of orders: some evaluated backwards, some with foreign evidence, some that depend in a circle or on slides there are not."""
    x, p, s, q, at = _lines(spark, d), *(F.col(c) for c in ("p", "s", "q", "order"))
    slides = x.select("paper_id", "slide_id", "order", F.array(_text("e", p), _text("f", q)).alias("evidence_ids"))
    evaluations = x.select("paper_id", F.when(F.col("paper_id") % 7 == 0, -at).otherwise(at).alias("pos"), "slide_id", F.when(s % 11 == 0, F.array(_text("e", p), _text("e", s))).otherwise(F.array(_text("f", q))).alias("evidence_ids"))
    before = F.when((q % 3 != 0) & (at > 1), _text("s", at - 1))
    circle = F.when((F.col("paper_id") % 5 == 0) & (at == 1), "s3")
    strange = F.when(p % 37 == 0, "s99")
    dependencies = x.select("paper_id", "slide_id", F.array_compact(F.array(before, circle, strange)).alias("prerequisite_slide_ids"))
    parts = _t(spark, d, "part").where("p_size <> 50").select(_text("e", F.col("p_partkey")).alias("id"))
    nodes = x.select("paper_id", _text("e", p).alias("id")).join(parts, "id", "left_semi").unionByName(x.select("paper_id", _text("f", q).alias("id")))
    return slides, evaluations, dependencies, nodes.distinct()


def draft_scope(spark, d):
    """What is wrong with the drafts: order, evidence, slides named, and circles."""
    slides, evaluations, dependencies, nodes = _drafts(spark, d)
    found = scope.scope_problems(slides, evaluations, dependencies, nodes)
    circles = scope.cycles(scope.closure(scope.needs(dependencies)))
    circles = circles.select("paper_id", F.lit("circle").alias("rule"), "slide_id", F.array_join("members", ", ").alias("detail"))
    return found.unionByName(circles).withColumnRenamed("paper_id", "l_orderkey")


def late_prerequisites(spark, d):
    """What slides depend on, through any number of others, and comes later."""
    slides, _, dependencies, _ = _drafts(spark, d)
    return scope.late_prerequisites(scope.closure(scope.needs(dependencies)), slides).withColumnRenamed("paper_id", "l_orderkey")


def _talks(spark, d):
    """(slides, elements, notes) of the conversations: a turn a slide, with its frame and notes."""
    c = _t(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("paper_id"), F.col("turn").cast("string").alias("slide_id"), (F.col("turn") + 1).alias("number"), "role", "text")
    slides = c.select(
        "paper_id", "slide_id", "number", F.col("role").alias("section"), F.when(F.col("number") % 2 == 0, "<tech>").alias("technical_title"), F.substring("text", 1, 20).alias("title"), F.array(_text("cited ", F.col("number"))).alias("citations"), F.when(F.col("number") % 3 != 0, "take & away").alias("takeaway"),
        F.lit("why").alias("notes_purpose"), F.col("role").alias("notes_message"), F.col("text").alias("notes_script"), F.lit("look").alias("notes_guidance"), F.lit("next").alias("notes_transition"), F.length("text").alias("notes_seconds"),
    )
    return slides, E.frame(slides), E.note_texts(slides)


def written_packages(spark, d):
    """Conversations written as slide packages and read back: how many slides and notes each has, which markers notes lack, and the boxes with their texts and places."""
    slides, elements, notes = _talks(spark, d)
    to = shared_path(spark, "packages")
    packages.write_packages(slides, elements, notes, to)
    back = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(to)
    conv = F.regexp_extract("path", r"([0-9]+)\.pptx$", 1).cast("long").alias("conv_id")
    parts = files.package_parts(back).select(conv, "n_slides", "n_notes", F.size("lacking").alias("n_lacking"), "problem")
    place = F.concat_ws(",", *[F.col(c).cast("string") for c in ("slide", "text", "x", "y", "cx", "cy")], (F.col("font") * 10).cast("int").cast("string"))
    boxes = files.slide_boxes(back).where("i IS NOT NULL").select(conv, F.struct("slide", "i").alias("at"), place.alias("place"))
    digest = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "place"))), lambda e: e["place"]), "|"), 256)
    return parts.join(boxes.groupBy("conv_id").agg(F.count("*").alias("n_boxes"), digest.alias("boxes")), "conv_id")


def _zipped(pdf):
    """The turns of one conversation as a zip archive; what is wrong with it follows from its number."""
    import io
    import zipfile

    import pandas as pd

    conv, out = int(pdf["conv_id"].iloc[0]), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for turn, text in sorted(zip(pdf["turn"], pdf["text"], strict=True)):
            z.writestr(f"../{turn}.txt" if conv % 10 == 3 and turn == 1 else f"turns/{turn}.txt", text)
    data = out.getvalue()
    return pd.DataFrame({"name": [f"c{conv}.zip"], "content": [data[:-30] if conv % 10 == 7 else data]})


def archive_contents(spark, d):
    """Conversations as archives, some unsafe and some torn, written and read by the archive source."""
    turns = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    to = shared_path(spark, "archives")
    staged.write_files(turns.groupBy("conv_id").applyInPandas(_zipped, "name string, content binary"), to)
    read = archives.read_archives(spark, to)
    unread = F.when(F.col("problem").startswith("unreadable"), "unreadable").otherwise(F.col("problem"))
    return read.select(F.regexp_extract("archive", r"c([0-9]+)\.zip$", 1).cast("long").alias("conv_id"), "member", "size", "sha256", unread.alias("problem"))


_Z = _X + """, z AS (SELECT *, o - 1 AS i, '$.slides[' || (o - 1) || ']' AS pth FROM x WHERE l_orderkey % 101 <> 0)"""
_KIND = "CASE WHEN p % 23 = 0 THEN 'photo' WHEN p % 4 = 1 THEN 'source_table' ELSE 'other' END"
_D = _X + """, e AS (SELECT DISTINCT l_orderkey, 's' || o AS a, 's' || (o - 1) AS b FROM x WHERE q % 3 <> 0 AND o > 1 UNION SELECT l_orderkey, 's1', 's3' FROM x WHERE l_orderkey % 5 = 0 AND o = 1 UNION SELECT l_orderkey, 's' || o, 's99' FROM x WHERE p % 37 = 0),
c AS (SELECT l_orderkey, a, b, 1 AS depth FROM e UNION SELECT c.l_orderkey, c.a, e.b, c.depth + 1 FROM c JOIN e ON c.l_orderkey = e.l_orderkey AND c.b = e.a WHERE c.depth < 10),
m AS (SELECT l_orderkey, a, b, min(depth) AS depth FROM c GROUP BY ALL)"""
QUERIES = {f.__name__: f for f in (spec_documents, draft_scope, late_prerequisites, written_packages, archive_contents)}
ORACLES = {
    "spec_documents": f"""WITH {_Z}
SELECT DISTINCT l_orderkey, '$' AS path, 'not JSON' AS problem FROM x WHERE l_orderkey % 101 = 0
UNION ALL SELECT DISTINCT l_orderkey, '$.theme', 'must be one of conference-minimal, group-meeting' FROM z WHERE l_orderkey % 6 = 0
UNION ALL SELECT DISTINCT l_orderkey, '$.presentation.translate_generic_labels', 'must be true' FROM z WHERE l_orderkey % 10 = 0
UNION ALL SELECT l_orderkey, '$.estimated_total_seconds', 'is not the sum of the notes'' seconds' FROM z GROUP BY l_orderkey HAVING bool_or(l_orderkey % 9 = 0) OR bool_or(s % 19 = 0)
UNION ALL SELECT l_orderkey, pth || '.visuals[0].kind', 'must be one of source_asset, source_table, source_equation, conceptual_diagram' FROM z WHERE p % 23 = 0
UNION ALL SELECT l_orderkey, pth || '.visuals[0].table_column_labels', 'only tables have column labels' FROM z WHERE q % 4 = 0 AND {_KIND} <> 'source_table'
UNION ALL SELECT l_orderkey, pth || '.visuals[0].table_column_labels[1]', 'must not be empty' FROM z WHERE q % 8 = 0
UNION ALL SELECT l_orderkey, pth || '.visuals[0].colour', 'unknown field' FROM z WHERE p % 17 = 0
UNION ALL SELECT l_orderkey, pth || '.speaker_notes.estimated_seconds', 'must be whole number, is text' FROM z WHERE s % 19 = 0
UNION ALL SELECT l_orderkey, pth || '.speaker_notes.script', 'must not be empty' FROM z WHERE p % 13 = 0
UNION ALL SELECT l_orderkey, pth || '.speaker_notes.mood', 'unknown field' FROM z WHERE s % 29 = 0
UNION ALL SELECT l_orderkey, pth || '.slide_id', 'repeated' FROM z WHERE p % 31 = 0 AND o > 1
UNION ALL SELECT l_orderkey, pth || '.title', 'must not be empty' FROM z WHERE s % 11 = 0
UNION ALL SELECT l_orderkey, pth || '.takeaway', 'missing' FROM z WHERE s % 7 = 0
UNION ALL SELECT l_orderkey, pth || '.order', 'must be ' || o FROM z WHERE q % 13 = 0
UNION ALL SELECT l_orderkey, pth || '.citations', 'must have 1 or more' FROM z WHERE q % 10 = 0""",
    "draft_scope": f"""WITH RECURSIVE {_D}, w AS (SELECT *, max(o) OVER (PARTITION BY l_orderkey) + 1 - o AS back FROM x),
n AS (SELECT DISTINCT l_orderkey, 'e' || p AS id FROM x JOIN part ON p = p_partkey WHERE p_size <> 50)
SELECT l_orderkey, 'evaluation_order' AS rule, 's' || back AS slide_id, 's' || o || '/s' || back AS detail FROM w WHERE l_orderkey % 7 = 0 AND o <> back
UNION ALL SELECT x.l_orderkey, 'foreign_evidence', 's' || o, string_agg(DISTINCT i, ', ' ORDER BY i) FROM x, (SELECT unnest([1, 2]) AS which) y, LATERAL (SELECT CASE which WHEN 1 THEN 'e' || p ELSE 'e' || s END AS i) z
  LEFT JOIN n ON n.l_orderkey = x.l_orderkey AND n.id = z.i WHERE s % 11 = 0 AND (i <> 'e' || p OR n.id IS NULL) GROUP BY x.l_orderkey, o
UNION ALL SELECT l_orderkey, 'unknown_prerequisite', a, string_agg(b, ', ' ORDER BY b) FROM e ANTI JOIN (SELECT l_orderkey, 's' || o AS b FROM x) v USING (l_orderkey, b) GROUP BY l_orderkey, a
UNION ALL SELECT m.l_orderkey, 'circle', m.a, string_agg(DISTINCT m.b, ', ' ORDER BY m.b) FROM m JOIN m r ON m.l_orderkey = r.l_orderkey AND m.a = r.b AND m.b = r.a GROUP BY m.l_orderkey, m.a""",
    "late_prerequisites": f"""WITH RECURSIVE {_D} SELECT m.l_orderkey, a AS slide_id, b AS needs, CAST(depth AS INTEGER) AS depth FROM m JOIN x u ON u.l_orderkey = m.l_orderkey AND 's' || u.o = a JOIN x v ON v.l_orderkey = m.l_orderkey AND 's' || v.o = b WHERE v.o >= u.o""",
    "written_packages": """WITH t AS (SELECT conv_id, turn + 1 AS k, role, text FROM conversations),
b AS (SELECT conv_id, k, unnest([struct_pack(z := 0, t := upper(role), x := 0.72, y := 0.2, w := 3.7, h := 0.25, f := 100), struct_pack(z := 1, t := CASE WHEN k % 2 = 0 THEN '<tech>' END, x := 8.6, y := 0.2, w := 3.85, h := 0.25, f := 110),
  struct_pack(z := 2, t := text[:20], x := 0.72, y := 0.56, w := 11.9, h := 0.75, f := 290), struct_pack(z := 6, t := CASE WHEN k % 3 <> 0 THEN 'take & away' END, x := 0.92, y := 6.49, w := 11.5, h := 0.43, f := 170),
  struct_pack(z := 7, t := 'cited ' || k, x := 0.72, y := 7.08, w := 11.9, h := 0.2, f := 100), struct_pack(z := 8, t := CASE WHEN k < 10 THEN '0' ELSE '' END || k, x := 12.35, y := 7.04, w := 0.28, h := 0.2, f := 90)]) AS e FROM t),
p AS (SELECT conv_id, k, e.z AS z, concat_ws(',', k, trim(replace(e.t, chr(10), '')), CAST(round(e.x * 914400) AS BIGINT), CAST(round(e.y * 914400) AS BIGINT), CAST(round(e.w * 914400) AS BIGINT), CAST(round(e.h * 914400) AS BIGINT), e.f) AS place FROM b WHERE trim(e.t) <> '')
SELECT conv_id, count(DISTINCT k) AS n_slides, count(DISTINCT k) AS n_notes, CAST(0 AS INTEGER) AS n_lacking, CAST(NULL AS VARCHAR) AS problem, count(*) AS n_boxes, sha256(string_agg(place, '|' ORDER BY k, z)) AS boxes FROM p GROUP BY conv_id""",
    "archive_contents": """SELECT conv_id, CASE WHEN conv_id % 10 = 3 THEN '../' ELSE 'turns/' END || turn || '.txt' AS member, CASE WHEN conv_id % 10 <> 3 THEN CAST(strlen(text) AS BIGINT) END AS size,
CASE WHEN conv_id % 10 <> 3 THEN sha256(text) END AS sha256, CASE WHEN conv_id % 10 = 3 THEN 'unsafe member' END AS problem FROM conversations WHERE conv_id % 10 <> 7 AND (conv_id % 10 <> 3 OR turn = 1 OR conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 1))
UNION ALL SELECT DISTINCT conv_id, NULL, CAST(NULL AS BIGINT), NULL, 'unreadable' FROM conversations WHERE conv_id % 10 = 7""",
}
