"""Issues, statuses and text views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_of(severity: str = "severity"):
    """fail with an error, else pass_with_warnings with a warning, else pass."""
    worst = F.max(F.when(F.col(severity) == "error", 2).when(F.col(severity) == "warning", 1).otherwise(0))
    return F.when(worst == 2, "fail").when(worst == 1, "pass_with_warnings").otherwise("pass")


def category_status(issues: DataFrame, categories: DataFrame) -> DataFrame:
    """(category, status, n_issues) of every category, also those without issues. Issues are counted before they meet the categories."""
    found = issues.groupBy("category").agg(status_of().alias("status"), F.count("severity").alias("n_issues"))
    return categories.join(found, "category", "left").select("category", F.coalesce("status", F.lit("pass")).alias("status"), F.coalesce("n_issues", F.lit(0)).cast("long").alias("n_issues"))


def joined_text(df: DataFrame, group: str, order: str, line, name: str = "view") -> DataFrame:
    """One text a group: its lines in order."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return df.groupBy(group).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias(name))


def recall(cases: DataFrame, found: DataFrame) -> DataFrame:
    """cases(case_id, expected) against found(case_id, code): detected, unexpected codes, for each case."""
    codes = found.groupBy("case_id").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    c = cases.join(codes, "case_id", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    return c.select("case_id", "expected", F.array_contains("codes", F.col("expected")).alias("detected"), F.size(F.array_except("codes", F.array("expected"))).alias("unexpected"))


# Headings and sentences of the rendered texts.
NOTES_PARTS = (("Purpose", "notes_purpose"), ("Main Message", "notes_message"), ("Speaking Script", "notes_script"), ("Visual Guidance", "notes_guidance"), ("Transition", "notes_transition"))
CATEGORY_LABELS = (("factual", "事实与证据"), ("storyline", "叙事结构"), ("visual", "视觉与文件"), ("presentation", "讲述与交付"))
NO_ISSUES = "未发现自动检查问题。"
NO_REPAIRS = "本次没有可安全自动修复的问题，Slide Spec 未被改写。"


def _lines(*parts) -> Column:
    return F.concat_ws("\n", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def speaker_notes(slides: DataFrame, titles: DataFrame) -> DataFrame:
    """(paper_id, text): the notes of each deck as Markdown, slide by slide, with the total time. titles(paper_id, title); slides as in `qa`, with notes_guidance."""
    parts = [x for head, c in NOTES_PARTS for x in (f"### {head}", "", F.coalesce(c, F.lit("")), "")]
    slide = _lines(F.concat(F.lit("## Slide "), F.col("order").cast("string"), F.lit(": "), F.col("title")), "", *parts, "### Estimated Time", "", F.concat(F.col("notes_seconds").cast("string"), F.lit(" seconds")), "")
    deck = joined_text(slides, "paper_id", "order", slide, "body").join(slides.groupBy("paper_id").agg(F.sum("notes_seconds").alias("total")), "paper_id").join(titles, "paper_id")
    tenths = F.bround(F.col("total") / 6).cast("long")  # of minutes, ties to even
    total = F.concat(F.col("total").cast("string"), F.lit(" seconds ("), F.format_string("%d.%d", (tenths / 10).cast("long"), tenths % 10), F.lit(" minutes)"))
    return deck.select("paper_id", _lines(F.concat(F.lit("# Speaker Notes: "), F.col("title")), "", F.col("body"), "## Estimated Total Presentation Time", "", total, "").alias("text"))


def outline(slides: DataFrame, titles: DataFrame) -> DataFrame:
    """(paper_id, text): purpose, message, evidence and time of each slide, and the totals."""
    slide = _lines(F.concat(F.lit("## Slide "), F.col("order").cast("string"), F.lit(" — "), F.col("title")), "", F.concat(F.lit("Purpose: "), F.col("purpose")), "", F.concat(F.lit("Core Message: "), F.col("main_claim")), "", F.concat(F.lit("Evidence: "), F.array_join("evidence_ids", ", ")), "", F.concat(F.lit("Estimated Time: "), F.col("notes_seconds").cast("string"), F.lit(" 秒")), "")
    deck = joined_text(slides, "paper_id", "order", slide, "body").join(slides.groupBy("paper_id").agg(F.sum("notes_seconds").alias("total"), F.count("*").alias("n")), "paper_id").join(titles, "paper_id")
    return deck.select("paper_id", _lines(F.concat(F.lit("# 演示提纲："), F.col("title")), "", F.col("body"), F.concat(F.lit("总计："), F.col("n").cast("string"), F.lit(" 页，"), F.col("total").cast("string"), F.lit(" 秒")), "").alias("text"))


def quality_report(papers: DataFrame, categories: DataFrame, issues: DataFrame, repairs: DataFrame | None = None) -> DataFrame:
    """(paper_id, text): status, counts by category, findings in order, and repairs.

    papers(paper_id, status, mode, theme, slide_count); categories(paper_id, category, status, n_issues, checks_run); issues as in `qa`, with a column pos for their order;
    repairs(paper_id, pos, slide_id, before, after)."""
    review = F.when(F.col("status") == "pass", "否").otherwise("是")
    head = _lines("# Quality Report", "", F.concat(F.lit("- 状态：`"), F.col("status"), F.lit("`")), F.concat(F.lit("- 论文 ID：`"), F.col("paper_id").cast("string"), F.lit("`")), F.concat(F.lit("- 模式：`"), F.col("mode"), F.lit("`")), F.concat(F.lit("- 主题：`"), F.col("theme"), F.lit("`")), F.concat(F.lit("- 页数："), F.col("slide_count").cast("string")), F.concat(F.lit("- 是否需要人工复核："), review), "", "## 分层结果", "", "| 层级 | 状态 | 检查数 | 问题数 |", "|---|---:|---:|---:|")
    names = F.create_map(*[F.lit(x) for kv in CATEGORY_LABELS for x in kv])
    place = F.array_position(F.array(*[F.lit(k) for k, _ in CATEGORY_LABELS]), F.col("category"))
    line = F.concat(F.lit("| "), F.element_at(names, F.col("category")), F.lit(" | `"), F.col("status"), F.lit("` | "), F.col("checks_run").cast("string"), F.lit(" | "), F.col("n_issues").cast("string"), F.lit(" |"))
    rows = joined_text(categories.withColumn("place", place), "paper_id", "place", line, "rows")
    scope = F.when(F.size("slide_ids") > 0, F.concat(F.lit("（"), F.array_join("slide_ids", ", "), F.lit("）"))).otherwise("")
    item = _lines(F.concat(F.lit("### "), F.upper("severity"), F.lit(" · "), F.col("code"), scope), "", F.col("message"), "", F.concat(F.lit("建议："), F.col("suggested_action")), "")
    found = joined_text(issues, "paper_id", "pos", item, "found")
    out = papers.join(rows, "paper_id", "left").join(found, "paper_id", "left")
    if repairs is not None:
        did = F.concat(F.lit("- `"), F.col("slide_id"), F.lit("`：`"), F.col("before"), F.lit("` → `"), F.col("after"), F.lit("`"))
        out = out.join(joined_text(repairs, "paper_id", "pos", did, "did"), "paper_id", "left")
    else:
        out = out.withColumn("did", F.lit(None).cast("string"))
    return out.select("paper_id", _lines(head, F.col("rows"), "", "## 问题清单", "", F.coalesce("found", F.lit(NO_ISSUES)), "## Repair History", "", F.coalesce("did", F.lit(NO_REPAIRS)), "").alias("text"))


def category_problems(categories: DataFrame) -> DataFrame:
    """categories(paper_id, category) -> (paper_id, lacking, strange): papers whose report does not have the four categories exactly."""
    names = F.array(*[F.lit(k) for k, _ in CATEGORY_LABELS])
    have = categories.groupBy("paper_id").agg(F.array_sort(F.collect_set("category")).alias("have"))
    return have.select("paper_id", F.array_except(names, "have").alias("lacking"), F.array_except("have", names).alias("strange")).where(F.size("lacking") + F.size("strange") > 0)
