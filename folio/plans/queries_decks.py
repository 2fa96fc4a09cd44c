"""Queries over decks: orders as papers, their lines as slides, with faults planted by the values of the lines; and conversations as talks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import authoring as A
from ..operators import qa as Q
from ..operators import reports as V


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _lines(spark, d, partitions=None):
    li = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("paper_id"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("long").alias("q"))
    li = li.repartition(partitions, "paper_id") if partitions else li
    at = F.row_number().over(Window.partitionBy("paper_id").orderBy("n", "p", "s", "q"))
    return li.withColumn("order", at).withColumn("unit_id", F.concat(F.lit("u"), F.col("order").cast("string"))).withColumn("slide_id", F.concat(F.lit("s"), F.col("order").cast("string")))


def _text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _deck(spark, d):
    """(units, slides) of every order; what a slide changes against its unit depends on part, supplier, line number and quantity."""
    x = _lines(spark, d)
    p, s, q, n = (F.col(c) for c in "psqn")
    units = x.select("paper_id", "unit_id", "order", _text("问题", p).alias("question"), _text("主张", s).alias("main_claim"), F.array(_text("e", p), _text("e", s)).alias("evidence_ids"), q.alias("seconds"))
    claim = F.when(s % 13 == 0, _text("改动", s)).otherwise(_text("主张", s))
    slides = x.select("paper_id", "slide_id", F.when(p % 29 == 0, _text("x", n)).otherwise(F.col("unit_id")).alias("unit_id"), "order", F.when(q % 10 == 0, "结果").when(q % 10 == 1, "Results").when(q % 10 == 2, _text("标题", p, "。")).otherwise(_text("标题 ", p)).alias("title"), F.when(p % 11 == 0, _text("别的问题", p)).otherwise(_text("问题", p)).alias("question"), claim.alias("main_claim"), F.array(_text("要点", s), F.when(q % 7 == 0, "plain line").otherwise("一行")).alias("body"), _text("结论", q).alias("takeaway"), F.lit("说明").alias("purpose"), F.when(p % 17 == 0, F.array(_text("e", p))).otherwise(F.array(_text("e", s), _text("e", p))).alias("evidence_ids"), F.when(s % 5 == 0, "full_visual").otherwise("table_focus").alias("layout"), F.when(p % 19 == 0, F.lit("另一个")).otherwise(claim).alias("notes_message"), F.when(s % 7 == 0, "别的").otherwise("说明").alias("notes_purpose"), F.when(p % 23 == 0, "other words").otherwise(_text("讲解标题 ", p, " 与主张")).alias("notes_script"), F.when(q % 6 == 0, "look here").otherwise("看图").alias("notes_guidance"), F.when(q % 8 == 0, "讲到这里结束").otherwise("接着看下一页").alias("notes_transition"), (q + F.when(q % 9 == 0, 1).otherwise(0)).alias("notes_seconds"))
    return units, slides


def spec_gates(spark, d):
    """Locked fields and language rules on all decks."""
    units, slides = _deck(spark, d)
    return A.locked_fields(units, slides).unionByName(A.language_violations(slides)).select(F.col("paper_id").alias("l_orderkey"), "rule", "slide_id", "detail")


def visual_gates(spark, d):
    """Every second slide shows a table of its part; parts of size 50 are unknown, small ones have no editable data, others have as many columns as the last digit of their brand."""
    x = _lines(spark, d)
    _, slides = _deck(spark, d)
    visuals = x.where("order % 2 = 0").select("paper_id", "slide_id", F.lit("source_table").alias("kind"), _text("t", F.col("p")).alias("source_ref"), F.lit("native_table").alias("treatment"), F.lit("main").alias("role"), F.transform(F.sequence(F.lit(1), (F.col("s") % 4 + 1).cast("int")), lambda i: i.cast("string")).alias("column_labels"))
    part = _t(spark, d, "part").where("p_size <> 50").select(_text("t", F.col("p_partkey")).alias("source_ref"), F.when(F.col("p_size") >= 10, F.regexp_extract("p_brand", r"(\d)$", 1).cast("int")).alias("columns"))
    known = x.select("paper_id", _text("t", F.col("p")).alias("source_ref")).distinct().join(part, "source_ref").select("paper_id", F.lit("source_table").alias("kind"), "source_ref", "columns")
    return A.visual_sources(slides, visuals, known).select(F.col("paper_id").alias("l_orderkey"), "rule", "slide_id", "detail")


def deck_presentation(spark, d):
    """Findings on timing, notes, titles and transitions of all decks, with what is suggested."""
    units, slides = _deck(spark, d)
    plans = units.groupBy("paper_id").agg(F.lit(100).alias("budget"), F.array().cast("array<string>").alias("coverage_gaps"))
    found = Q.presentation(slides, units, plans)
    return found.select(F.col("paper_id").alias("l_orderkey"), "category", "code", "severity", F.array_join("slide_ids", ",").alias("slides"), "repairability", "field_path")


def deck_storyline(spark, d):
    """Order, drift and repeated claims of all decks; roles of units follow their quantities."""
    units, slides = _deck(spark, d)
    roles = ["opening", "problem", "core_insight", "method_overview", "experiments", "limitations", "conclusion"]
    units = units.withColumn("role", F.element_at(F.array(*map(F.lit, roles)), (F.col("seconds") % len(roles) + 1).cast("int")))
    plans = units.groupBy("paper_id").agg(F.lit(100).alias("budget"), F.when(F.count("*") == 1, F.array(F.lit("gap"))).otherwise(F.array().cast("array<string>")).alias("coverage_gaps"))
    found = Q.storyline(slides, units, plans)
    return found.groupBy(F.col("paper_id").alias("l_orderkey"), "code", "severity", "repairability").agg(F.count("*").alias("n"))


def package_rules(spark, d):
    """Parts as packages: small ones cannot be read, the others have a width of their price and a height of 9 sixteenths of it, but for those of odd brands."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("paper_id"), F.col("p_retailprice").cast("double").alias("width"), F.when(F.regexp_extract("p_brand", r"(\d)$", 1).cast("int") % 2 == 1, 1.0).otherwise(F.col("p_retailprice").cast("double") * 9 / 16).alias("height"), F.when(F.col("p_size") < 5, "bad zip").alias("problem"))
    return Q.package_findings(p).select(F.col("paper_id").alias("p_partkey"), "code", "severity", "repairability", "message")


def preview_rules(spark, d):
    """Orders as decks, their lines as slides: packages and previews of each have some too many or too few, unreadable, small or badly shaped."""
    x, k = _lines(spark, d), F.col("paper_id")
    slides = x.select("paper_id", "slide_id", "order")
    n = slides.groupBy("paper_id").agg(F.count("*").alias("n"))
    parts = n.select("paper_id", (F.col("n") + F.when(k % 11 == 0, 1).otherwise(0)).alias("n_slides"), (F.col("n") - F.when(k % 13 == 0, 1).otherwise(0)).alias("n_notes"))
    some = x.where((k % 6 != 0) & ~((k % 7 == 0) & (F.col("order") == 1)))
    width = F.when(F.col("q") % 10 == 0, F.lit(None)).when(F.col("q") % 10 == 1, 800).otherwise(1600)
    previews = some.select("paper_id", F.format_string("slide_%04d.png", F.col("order")).alias("name"), width.cast("int").alias("w"), F.when(F.col("q") % 10 == 2, 1600).otherwise(F.when(F.col("q") % 10 == 1, 450).otherwise(900)).alias("h"))
    found = Q.part_findings(parts, slides).unionByName(Q.preview_findings(previews, slides))
    return found.select(F.col("paper_id").alias("l_orderkey"), "code", "severity", "message", F.array_join("slide_ids", ",").alias("slides"))


def _talks(spark, d):
    c = _t(spark, d, "conversations")
    chars = F.length("text")
    slides = c.select(F.col("conv_id").alias("paper_id"), (F.col("turn") + 1).alias("order"), F.col("role").alias("title"), F.lit("why").alias("purpose"), F.lit("why").alias("notes_purpose"), F.col("role").alias("main_claim"), F.col("role").alias("notes_message"), F.col("text").alias("notes_script"), F.lit("look").alias("notes_guidance"), F.lit("next").alias("notes_transition"), chars.cast("long").alias("notes_seconds"), F.array("role", F.concat(F.lit("e"), F.col("turn").cast("string"))).alias("evidence_ids"))
    return slides, c.select(F.col("conv_id").alias("paper_id"), F.concat(F.lit("talk "), F.col("conv_id").cast("string")).alias("title")).distinct()


def speaker_notes(spark, d):
    return V.speaker_notes(*_talks(spark, d)).select(F.col("paper_id").alias("conv_id"), F.sha2("text", 256).alias("digest"), F.length("text").alias("n_chars"))


def talk_outline(spark, d):
    return V.outline(*_talks(spark, d)).select(F.col("paper_id").alias("conv_id"), "text")


def quality_reports(spark, d):
    """A report for each source of documents: toxic ones are errors of category visual, bad ones warnings of category factual."""
    j = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "source"), "doc_id").where("source IS NOT NULL")
    j = j.select(F.col("source").alias("paper_id"), "doc_id", F.when(F.col("toxic") == 1, "visual").when(F.col("quality") == 0, "factual").alias("category"), F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "warning").alias("severity"))
    issues = j.where("category IS NOT NULL").select("paper_id", "category", "severity", F.col("doc_id").alias("pos"), F.upper("category").alias("code"), F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("message"), F.array(F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("slide_ids"), F.lit("look").alias("suggested_action"))
    per = lambda c: F.count_if(F.col("category") == c)
    counts = j.groupBy("paper_id").agg(F.count("*").alias("checks_run"), V.status_of().alias("status"), *[per(c).alias(c) for c in ("factual", "visual")])
    papers = counts.select("paper_id", "status", F.lit("paper-reading").alias("mode"), F.lit("plain").alias("theme"), F.col("checks_run").alias("slide_count"))
    rows = F.array(F.struct(F.lit("factual").alias("category"), F.when(F.col("factual") > 0, "pass_with_warnings").otherwise("pass").alias("status"), F.col("factual").alias("n_issues")), F.struct(F.lit("visual").alias("category"), F.when(F.col("visual") > 0, "fail").otherwise("pass").alias("status"), F.col("visual").alias("n_issues")))
    categories = counts.select("paper_id", "checks_run", F.explode(rows).alias("r")).select("paper_id", "checks_run", "r.*")
    return V.quality_report(papers, categories, issues).select(F.col("paper_id").alias("source"), F.sha2("text", 256).alias("digest"), F.length("text").alias("n_chars"))


_X = """x AS (SELECT l_orderkey, l_partkey AS p, l_suppkey AS s, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT)) AS o FROM lineitem)"""
_Y = _X + """, y AS (SELECT *, 's' || o AS slide_id, CASE WHEN p % 29 = 0 THEN 'x' || n ELSE 'u' || o END AS unit_id, CASE q % 10 WHEN 0 THEN '结果' WHEN 1 THEN 'Results' WHEN 2 THEN '标题' || p || '。' ELSE '标题 ' || p END AS title,
  CASE WHEN s % 13 = 0 THEN '改动' || s ELSE '主张' || s END AS claim, q + CASE WHEN q % 9 = 0 THEN 1 ELSE 0 END AS secs FROM x)"""
_CJK = r"regexp_matches({}, '[\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}]')"
QUERIES = {f.__name__: f for f in (spec_gates, visual_gates, deck_presentation, deck_storyline, package_rules, preview_rules, speaker_notes, talk_outline, quality_reports)}
ORACLES = {
    "spec_gates": f"""WITH {_Y}, same AS (SELECT * FROM y WHERE p % 29 <> 0)
SELECT l_orderkey, 'unit_order' AS rule, slide_id, 'u' || o AS detail FROM y WHERE p % 29 = 0 UNION ALL SELECT l_orderkey, 'question', slide_id, unit_id FROM same WHERE p % 11 = 0 UNION ALL SELECT l_orderkey, 'main_claim', slide_id, unit_id FROM same WHERE s % 13 = 0
UNION ALL SELECT l_orderkey, 'evidence_ids', slide_id, unit_id FROM same WHERE p % 17 = 0 AND p <> s UNION ALL SELECT l_orderkey, 'notes_message', slide_id, unit_id FROM same WHERE p % 19 = 0 UNION ALL SELECT l_orderkey, 'notes_seconds', slide_id, unit_id FROM same WHERE q % 9 = 0
UNION ALL SELECT l_orderkey, 'not_chinese', slide_id, 'title' FROM y WHERE NOT {_CJK.format('title')} UNION ALL SELECT l_orderkey, 'not_chinese', slide_id, 'notes_script' FROM y WHERE p % 23 = 0
UNION ALL SELECT l_orderkey, 'not_chinese', slide_id, 'notes_guidance' FROM y WHERE q % 6 = 0 UNION ALL SELECT l_orderkey, 'not_chinese', slide_id, 'body[1]' FROM y WHERE q % 7 = 0""",
    "visual_gates": f"""WITH {_X}, v AS (SELECT x.*, p_size, CASE WHEN p_size >= 10 THEN CAST(right(p_brand, 1) AS INTEGER) END AS cols, p_partkey IS NOT NULL AND p_size <> 50 AS known FROM x LEFT JOIN part ON p_partkey = p WHERE o % 2 = 0)
SELECT l_orderkey, 'unknown_visual' AS rule, 's' || o AS slide_id, 'source_table/t' || p AS detail FROM v WHERE NOT known UNION ALL SELECT l_orderkey, 'labels_without_table', 's' || o, 't' || p FROM v WHERE known AND cols IS NULL
UNION ALL SELECT l_orderkey, 'column_labels', 's' || o, s % 4 + 1 || '/' || cols FROM v WHERE known AND cols <> s % 4 + 1 UNION ALL SELECT l_orderkey, 'full_visual', 's' || o, 'no visual' FROM x WHERE s % 5 = 0 AND o % 2 = 1""",
    "deck_presentation": f"""WITH {_Y}, g AS (SELECT l_orderkey, sum(secs) AS spec, sum(q) AS plan, max(o) AS last FROM y GROUP BY l_orderkey), z AS (SELECT y.*, o = last AS is_last FROM y JOIN g USING (l_orderkey))
SELECT l_orderkey, 'presentation' AS category, 'TIMING_DRIFT' AS code, 'error' AS severity, '' AS slides, 'none' AS repairability, NULL AS field_path FROM g WHERE spec <> plan UNION ALL SELECT l_orderkey, 'presentation', 'TIME_BUDGET_EXCEEDED', 'error', '', 'manual', NULL FROM g WHERE spec > 100
UNION ALL SELECT l_orderkey, 'presentation', 'NOTES_MAIN_MESSAGE_DRIFT', 'error', slide_id, 'manual', NULL FROM z WHERE p % 19 = 0 UNION ALL SELECT l_orderkey, 'presentation', 'NOTES_PURPOSE_DRIFT', 'warning', slide_id, 'manual', NULL FROM z WHERE s % 7 = 0
UNION ALL SELECT l_orderkey, 'presentation', 'SCRIPT_CONTENT_DRIFT', 'warning', slide_id, 'manual', NULL FROM z WHERE p % 23 = 0 OR (s % 13 = 0 AND q % 10 < 2 AND p <> s)
UNION ALL SELECT l_orderkey, 'presentation', 'TITLE_TRAILING_PUNCTUATION', 'warning', slide_id, 'automatic', 'slides[' || (o - 1) || '].title' FROM z WHERE q % 10 = 2
UNION ALL SELECT l_orderkey, 'presentation', 'EARLY_CLOSING_TRANSITION', 'warning', slide_id, 'manual', NULL FROM z WHERE q % 8 = 0 AND NOT is_last UNION ALL SELECT l_orderkey, 'presentation', 'MISSING_CLOSING_TRANSITION', 'info', slide_id, 'manual', NULL FROM z WHERE q % 8 <> 0 AND is_last""",
    "deck_storyline": f"""WITH {_Y}, r AS (SELECT *, q % 7 AS role FROM y), g AS (SELECT l_orderkey, count(*) AS n, coalesce(min(o) FILTER (role = 1), 1000000) AS a, coalesce(min(o) FILTER (role IN (2, 3)), 1000000) AS b, coalesce(min(o) FILTER (role = 4), 1000000) AS c, coalesce(min(o) FILTER (role = 6), 1000000) AS e,
  bool_or(role = 5) AS lim, bool_or(p % 29 = 0) AS moved FROM r GROUP BY l_orderkey),
k AS (SELECT *, lag(o) OVER (PARTITION BY l_orderkey, claim ORDER BY o) AS before FROM r),
f AS (SELECT l_orderkey, 'PLAN_SPEC_ORDER_MISMATCH' AS code, 'error' AS severity, 'none' AS repairability FROM g WHERE moved UNION ALL SELECT l_orderkey, 'MISSING_STORYLINE_STAGE', 'error', 'none' FROM (SELECT l_orderkey, unnest([a, b, c, e]) AS place FROM g) WHERE place = 1000000
  UNION ALL SELECT l_orderkey, 'MISSING_LIMITATIONS', 'warning', 'manual' FROM g WHERE NOT lim UNION ALL SELECT l_orderkey, 'STORYLINE_ORDER', 'error', 'none' FROM g WHERE a > b OR b > c OR c > e UNION ALL SELECT l_orderkey, 'DUPLICATE_MAIN_CLAIM', 'warning', 'manual' FROM k WHERE before IS NOT NULL
  UNION ALL SELECT l_orderkey, 'UNIT_CONTENT_DRIFT', 'error', 'none' FROM r WHERE p % 29 <> 0 AND (p % 11 = 0 OR s % 13 = 0 OR p % 17 = 0 OR p <> s) UNION ALL SELECT l_orderkey, 'DECLARED_COVERAGE_GAP', 'warning', 'manual' FROM g WHERE n = 1)
SELECT l_orderkey, code, severity, repairability, count(*) AS n FROM f GROUP BY ALL""",
    "package_rules": """SELECT p_partkey, 'INVALID_PPTX_PACKAGE' AS code, 'error' AS severity, 'none' AS repairability, '无法检查 PPTX 包：bad zip' AS message FROM part WHERE p_size < 5
UNION ALL SELECT p_partkey, 'INVALID_SLIDE_ASPECT', 'error', 'none', 'PPTX 画布不是有效的 16:9 尺寸。' FROM part WHERE p_size >= 5 AND NOT coalesce(p_retailprice > 0 AND abs(CAST(p_retailprice AS DOUBLE) / CASE WHEN CAST(right(p_brand, 1) AS INTEGER) % 2 = 1 THEN 1.0 ELSE CAST(p_retailprice AS DOUBLE) * 9 / 16 END - 16.0 / 9) <= 0.01, false)""",
    "preview_rules": f"""WITH {_X}, n AS (SELECT l_orderkey AS k, count(*) AS n FROM x GROUP BY 1), c AS (SELECT k, n, CASE WHEN k % 7 = 0 THEN n - 1 ELSE n END AS have FROM n WHERE k % 6 <> 0),
e AS (SELECT l_orderkey AS k, q % 10 AS f, 'slide_' || lpad(CAST(o AS VARCHAR), 4, '0') || '.png' AS name, 's' || CASE WHEN l_orderkey % 7 = 0 THEN o - 1 ELSE o END AS slide FROM x WHERE l_orderkey % 6 <> 0 AND NOT (l_orderkey % 7 = 0 AND o = 1))
SELECT k AS l_orderkey, 'SLIDE_COUNT_MISMATCH' AS code, 'error' AS severity, 'PPTX 含 ' || (n + 1) || ' 页，但 Slide Spec 定义 ' || n || ' 页。' AS message, '' AS slides FROM n WHERE k % 11 = 0
UNION ALL SELECT k, 'MISSING_NOTES_PART', 'error', 'PPTX 只有 ' || (n - 1) || ' 个 notes part，预期 ' || n || ' 个。', '' FROM n WHERE k % 13 = 0
UNION ALL SELECT k, 'PREVIEW_NOT_RENDERED', 'warning', '未生成逐页 PNG，因此视觉 QA 只完成了结构检查。', '' FROM n WHERE k % 6 = 0 OR (k % 7 = 0 AND n = 1)
UNION ALL SELECT k, 'PREVIEW_COUNT_MISMATCH', 'error', '预览目录含 ' || have || ' 张 PNG，预期 ' || n || ' 张。', '' FROM c WHERE have <> n AND have > 0
UNION ALL SELECT k, 'INVALID_PREVIEW_IMAGE', 'error', name || ' 不是可读取的 PNG。', slide FROM e WHERE f = 0
UNION ALL SELECT k, 'LOW_QUALITY_PREVIEW', 'warning', name || ' 的分辨率或宽高比不足：' || CASE WHEN f = 1 THEN '800x450' ELSE '1600x1600' END || '。', slide FROM e WHERE f IN (1, 2)""",
    "speaker_notes": """WITH t AS (SELECT conv_id, sum(length(text)) AS total, string_agg('## Slide ' || (turn + 1) || ': ' || role || chr(10) || chr(10) || '### Purpose' || chr(10) || chr(10) || 'why' || chr(10) || chr(10) || '### Main Message' || chr(10) || chr(10) || role || chr(10) || chr(10) || '### Speaking Script' || chr(10) || chr(10) || text || chr(10) || chr(10)
 || '### Visual Guidance' || chr(10) || chr(10) || 'look' || chr(10) || chr(10) || '### Transition' || chr(10) || chr(10) || 'next' || chr(10) || chr(10) || '### Estimated Time' || chr(10) || chr(10) || length(text) || ' seconds' || chr(10), chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id),
x AS (SELECT conv_id, '# Speaker Notes: talk ' || conv_id || chr(10) || chr(10) || body || chr(10) || '## Estimated Total Presentation Time' || chr(10) || chr(10) || total || ' seconds (' || CAST(floor(round_even(total / 6, 0) / 10) AS BIGINT) || '.' || CAST(round_even(total / 6, 0) AS BIGINT) % 10 || ' minutes)' || chr(10) AS text FROM t)
SELECT conv_id, sha256(text) AS digest, CAST(length(text) AS INTEGER) AS n_chars FROM x""",
    "talk_outline": """SELECT conv_id, '# 演示提纲：talk ' || conv_id || chr(10) || chr(10) || string_agg('## Slide ' || (turn + 1) || ' — ' || role || chr(10) || chr(10) || 'Purpose: why' || chr(10) || chr(10) || 'Core Message: ' || role || chr(10) || chr(10) || 'Evidence: ' || role || ', e' || turn || chr(10) || chr(10) || 'Estimated Time: ' || length(text) || ' 秒' || chr(10), chr(10) ORDER BY turn)
 || chr(10) || '总计：' || count(*) || ' 页，' || sum(length(text)) || ' 秒' || chr(10) AS text FROM conversations GROUP BY conv_id""",
    "quality_reports": """WITH j AS (SELECT source, doc_id, CASE WHEN toxic = 1 THEN 'visual' WHEN quality = 0 THEN 'factual' END AS c, CASE WHEN toxic = 1 THEN 'ERROR' WHEN quality = 0 THEN 'WARNING' END AS sev FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL),
g AS (SELECT source, count(*) AS n, count(*) FILTER (c = 'visual') AS v, count(*) FILTER (c = 'factual') AS f, string_agg('### ' || sev || ' · ' || upper(c) || '（s' || doc_id || '）' || chr(10) || chr(10) || 'doc ' || doc_id || chr(10) || chr(10) || '建议：look' || chr(10), chr(10) ORDER BY doc_id) FILTER (c IS NOT NULL) AS found FROM j GROUP BY source),
x AS (SELECT source, concat_ws(chr(10), '# Quality Report', '', '- 状态：`' || CASE WHEN v > 0 THEN 'fail' WHEN f > 0 THEN 'pass_with_warnings' ELSE 'pass' END || '`', '- 论文 ID：`' || source || '`', '- 模式：`paper-reading`', '- 主题：`plain`', '- 页数：' || n, '- 是否需要人工复核：' || CASE WHEN v + f > 0 THEN '是' ELSE '否' END, '', '## 分层结果', '',
 '| 层级 | 状态 | 检查数 | 问题数 |', '|---|---:|---:|---:|', '| 事实与证据 | `' || CASE WHEN f > 0 THEN 'pass_with_warnings' ELSE 'pass' END || '` | ' || n || ' | ' || f || ' |', '| 视觉与文件 | `' || CASE WHEN v > 0 THEN 'fail' ELSE 'pass' END || '` | ' || n || ' | ' || v || ' |', '', '## 问题清单', '', coalesce(found, '未发现自动检查问题。'), '## Repair History', '', '本次没有可安全自动修复的问题，Slide Spec 未被改写。', '') AS text FROM g)
SELECT source, sha256(text) AS digest, CAST(length(text) AS INTEGER) AS n_chars FROM x""",
}
