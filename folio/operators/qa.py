"""Findings on slide decks: one DataFrame of issues for each group of rules.

Inputs are flat tables, each with paper_id; order columns count from 1:
  slides(paper_id, slide_id, unit_id, order, title, question, main_claim, body ARRAY<STRING>, takeaway, purpose, evidence_ids ARRAY<STRING>,
         notes_message, notes_purpose, notes_script, notes_transition, notes_seconds)
  citations(paper_id, slide_id, evidence_id, source_ids ARRAY<STRING>)
  visuals(paper_id, slide_id, kind, source_ref, treatment, role)
  nodes(paper_id, id, type, claim, confidence, source_ids ARRAY<STRING>, excerpts ARRAY<STRING>)
  units(paper_id, unit_id, order, role, question, main_claim, evidence_ids ARRAY<STRING>, seconds)
  plans(paper_id, budget, coverage_gaps ARRAY<STRING>)
Papers are independent, so every join and window is keyed by paper_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions.ids import issue_id, repair_id
from . import planning as P

# Fixed values that results depend on.
QA_METHOD_ROLES = ("core_insight", "contributions", "method_overview", "method_component")
STAGES = (("problem", ("problem",)), ("method", QA_METHOD_ROLES), ("evidence", P.EVIDENCE_ROLES), ("ending", P.ENDING_ROLES))
RESULT_TYPES = ("experimental_result", "ablation_result")
CLOSING = ("结束", "问答", "讨论")
NO_INDEX = 10**6
TREATMENTS = {"source_table": ("native_table", "crop", "highlight"), "source_equation": ("equation", "highlight"), "conceptual_diagram": ("diagram",)}
NOT_FOR_ASSETS = ("native_table", "equation", "diagram")
# Whether a finding can be repaired, and what is suggested. The messages below are fixed values too: they are part of an issue's id.
ACTIONS = {
    "PAPER_ID_MISMATCH": ("none", "重新运行上游阶段并确认所有 artifact 来自同一篇论文。"),
    "UNKNOWN_EVIDENCE": ("none", "回到 Evidence Graph 或 Slide Spec 修正引用，禁止自动补造证据。"),
    "MISSING_CITATION": ("manual", "由 evidence node 的 source locator 重新生成 citation。"),
    "CITATION_SOURCE_MISMATCH": ("none", "使用 evidence node 中已有的 source locator，不能自由填写来源。"),
    "UNSUPPORTED_NUMBER": ("none", "补充已有 evidence 引用或删除无来源数字；禁止 QA 自动改写数值。"),
    "UNKNOWN_SOURCE_ASSET": ("none", "修正 visual_manifest 或 Slide Spec 的 source_ref。"),
    "SOURCE_ASSET_HASH_MISMATCH": ("none", "从原始论文重新提取视觉资产并更新 manifest。"),
    "UNKNOWN_SOURCE_TABLE": ("none", "修正 Paper Structure 或表格引用。"),
    "UNKNOWN_SOURCE_EQUATION": ("none", "修正 Paper Structure 或公式引用。"),
    "GENERATED_EXPERIMENT_VISUAL": ("manual", "实验页改用论文原始 Figure/Table，或明确标注为解释性示意图。"),
    "LOW_CONFIDENCE_EVIDENCE": ("manual", "人工核对原文并决定是否保留或降级该 claim。"),
    "PLAN_SPEC_ORDER_MISMATCH": ("none", "重新运行 Slide Authoring，不能由 QA 猜测页面顺序。"),
    "MISSING_STORYLINE_STAGE": ("none", "回到 Presentation Plan 补齐证据支持的叙事单元。"),
    "MISSING_LIMITATIONS": ("manual", "人工确认论文是否确实没有可讲的限制，或补充受证据支持的限制页面。"),
    "STORYLINE_ORDER": ("none", "在 Presentation Plan 中重排 units，并重新生成 Slide Spec。"),
    "DUPLICATE_MAIN_CLAIM": ("manual", "合并重复页面，或明确两页分别回答的不同问题。"),
    "UNIT_CONTENT_DRIFT": ("none", "重新运行 Slide Authoring，保持 Plan 到 Spec 的锁定字段。"),
    "DECLARED_COVERAGE_GAP": ("manual", "人工确认该缺口源于证据不足还是时间压缩；不要自动补写内容。"),
    "TIMING_DRIFT": ("none", "重新生成 Slide Spec，并保留每个 unit 的时间预算。"),
    "TIME_BUDGET_EXCEEDED": ("manual", "回到 deterministic compression 调整页面选择。"),
    "NOTES_MAIN_MESSAGE_DRIFT": ("manual", "以 Slide Spec 的 main claim 为准重新生成讲稿。"),
    "NOTES_PURPOSE_DRIFT": ("manual", "统一页面目的与讲稿目的。"),
    "SCRIPT_CONTENT_DRIFT": ("manual", "人工核对讲稿是否真正解释了页面核心信息。"),
    "TITLE_TRAILING_PUNCTUATION": ("automatic", "删除标题结尾标点，不改变标题语义或证据。"),
    "EARLY_CLOSING_TRANSITION": ("manual", "改写 transition，使其自然引向下一页。"),
    "MISSING_CLOSING_TRANSITION": ("manual", "人工决定是否加入结束或 Q&A 提示。"),
    "INVALID_SLIDE_ASPECT": ("none", "检查 Renderer 的 presentation layout 设置。"),
    "OUT_OF_BOUNDS_TEXT": ("manual", "调整对应 layout/component 的几何参数后重渲染。"),
    "UNREADABLY_SMALL_FONT": ("manual", "缩短文字或扩大文本区域，避免继续缩小字号。"),
    "LIKELY_TEXT_OVERFLOW": ("manual", "检查对应 PNG；优先改写或调整布局，而不是机械缩小字体。"),
    "TEXT_BOX_OVERLAP": ("manual", "调整 Renderer 几何参数并仅重渲染该页进行复检。"),
    "NATIVE_TABLE_MISSING": ("manual", "修复表格 renderer，不能用截图替代要求的可编辑表格。"),
    "INVALID_PPTX_PACKAGE": ("none", "重新渲染 PPTX 并检查 OOXML package。"),
    "SLIDE_COUNT_MISMATCH": ("none", "重新渲染完整 deck，不能用 partial review deck 作为最终输出。"),
    "MISSING_NOTES_PART": ("manual", "重新渲染并确认每页调用了 addNotes。"),
    "PREVIEW_NOT_RENDERED": ("manual", "在可用的 Office/PDF 环境中重新运行 qa，生成 PDF 和逐页预览。"),
    "PREVIEW_COUNT_MISMATCH": ("manual", "重新从最终 PDF 生成全部页面预览。"),
    "INVALID_PREVIEW_IMAGE": ("manual", "重新渲染该页预览。"),
    "LOW_QUALITY_PREVIEW": ("manual", "以至少 960x540 的 16:9 分辨率重新渲染。"),
    "RENDER_INSPECT_UNAVAILABLE": ("none", "安装可用的 PowerPoint/LibreOffice 与 PyMuPDF 后重新运行 qa。"),
    "CLAIM_EVIDENCE_UNSUPPORTED": ("none", "回到 Evidence Graph 或 Slide Spec 人工修正 claim/证据映射，禁止 QA 自动改写。"),
    "CLAIM_EVIDENCE_PARTIAL": ("none", "人工缩窄 claim 或补充已有证据；不要让 evaluator 自行生成新事实。"),
    "CLAIM_EVIDENCE_INSUFFICIENT": ("none", "人工复核原文定位并决定补充证据、缩窄 claim 或保留显式不确定性。"),
    "CLAIM_STRENGTH_OVERSTATED": ("none", "人工校准因果、显著性、普遍性或 SOTA 等措辞，保持原始证据不变。"),
    "CLAIM_STRENGTH_UNDERSTATED": ("manual", "仅在人工确认不改变论文原意时增强措辞；该提示不要求修改。"),
    "STORYLINE_PREREQUISITE_MISSING": ("none", "人工补充受证据支持的前置解释，或降低本页对该概念的依赖。"),
    "STORYLINE_DEPENDENCY_ORDER": ("none", "在 Presentation Plan 中调整顺序或增加前置解释，再重新生成 Slide Spec。"),
}
COLUMNS = ("paper_id", "category", "code", "severity", "message", "slide_ids", "evidence_ids", "source_ids", "field_path", "issue_id", "repairability", "suggested_action")
_STRINGS = "array<string>"


def _none() -> Column:
    return F.array().cast(_STRINGS)


def issues(df: DataFrame, category: str, code, severity, message: Column, slides: Column | None = None, evidence: Column | None = None, sources: Column | None = None, field_path: Column | None = None) -> DataFrame:
    """Rows of df as issues; the id comes from category, code, message, slides and field, so equal findings have equal ids."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = df.select("paper_id", F.lit(category).alias("category"), as_col(code).alias("code"), as_col(severity).alias("severity"), message.alias("message"), (slides if slides is not None else _none()).alias("slide_ids"), (evidence if evidence is not None else _none()).alias("evidence_ids"), (sources if sources is not None else _none()).alias("source_ids"), (field_path if field_path is not None else F.lit(None).cast("string")).alias("field_path"))
    action = lambda k, other: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for c, a in ACTIONS.items() for x in (c, a[k])]), F.col("code")), F.lit(other))
    out = out.withColumn("issue_id", issue_id(F.col("category"), F.col("code"), F.col("message"), F.col("slide_ids"), F.col("field_path")))
    return out.withColumn("repairability", action(0, "manual")).withColumn("suggested_action", action(1, ""))


def union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_slide = lambda: F.array("slide_id")


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def factual(slides: DataFrame, citations: DataFrame, visuals: DataFrame, nodes: DataFrame, known_visuals: DataFrame, agreeing: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """Evidence, citations, numbers, and visual sources. A slide with unknown evidence gets only that finding.

    known_visuals(paper_id, kind, source_ref, intact): what may be referred to; intact is false for a changed or missing file.
    agreeing(paper_id, n): papers whose artifacts name n different papers.
    partitions: of the one shuffle, where its size on disk says little about the rows; tables that lie in so many by paper are not shuffled again.
    All tables are put under each other and shuffled once, by paper; what belongs together then meets in two windows within its paper instead of joins: evidence and files with what names them, and all of a
    slide. Texts go into neither, only the numbers in them; what evidence or a file means for a row is settled before rows meet by slide.
    """
    if "pos" in citations.columns:  # of several citations of an evidence on a slide the last one counts
        citations = citations.groupBy("paper_id", "slide_id", "evidence_id").agg(F.max_by(F.struct("source_ids"), "pos").alias("c")).select("paper_id", "slide_id", "evidence_id", "c.source_ids")
    said = F.concat_ws(" ", F.col("claim"), F.array_join("excerpts", " "))
    node = F.struct(F.coalesce(F.col("type").isin(*RESULT_TYPES), F.lit(False)).alias("result"), F.coalesce(F.col("confidence") == "low", F.lit(False)).alias("low"), N.number_keys(said).alias("numbers"), F.col("source_ids").alias("expected"))
    spoken = F.concat_ws(" ", "title", "main_claim", F.array_join("body", " "), "takeaway")
    of = lambda what, ref: [F.lit(what).alias("of"), F.col(ref).alias("ref")]
    slide, use, citation, visual = (F.lit(i) for i in range(4))
    every = _under(
        slides.select("paper_id", "slide_id", *of("slide", "slide_id"), slide.alias("is"), "evidence_ids", N.number_keys(spoken).alias("numbers")),
        slides.select("paper_id", "slide_id", F.posexplode("evidence_ids").alias("pos", "id")).select("paper_id", "slide_id", *of("node", "id"), use.alias("is"), "pos"),
        citations.select("paper_id", "slide_id", *of("node", "evidence_id"), citation.alias("is"), "source_ids"), nodes.select("paper_id", *of("node", "id"), node.alias("node")),
        visuals.select("paper_id", "slide_id", *of("file", "source_ref"), visual.alias("is"), "kind"), known_visuals.select("paper_id", *of("file", "source_ref"), "kind", F.struct("intact").alias("file")),
    )
    every = every.repartition(partitions, "paper_id") if partitions else every.repartition("paper_id")
    alike = Window.partitionBy("paper_id", "of", "ref", "kind")
    met = every.withColumns({c + "s": F.collect_list(c).over(alike) for c in ("node", "file")}).where("is IS NOT NULL")
    named = F.col("paper_id").isNotNull() & F.col("ref").isNotNull()
    met = met.withColumn("nodes", F.when(named, F.col("nodes")).otherwise(F.array().cast(met.schema["nodes"].dataType)))
    wrong = F.size(F.filter("nodes", lambda n: (F.size("source_ids") == 0) | (F.size(F.array_except("source_ids", n["expected"])) > 0)))
    intact = F.when(named & F.col("kind").isNotNull() & (F.size("files") > 0), F.transform("files", lambda f: f["intact"])).otherwise(F.array(F.lit(None).cast("boolean")))
    per = lambda what, c: F.when(F.col("is") == what, c)
    met = met.select(
        "paper_id", "slide_id", "is", "pos", "ref", "kind", "evidence_ids", per(use, F.size("nodes")).alias("known"), per(use, F.size(F.filter("nodes", lambda n: n["low"]))).alias("low"), per(use, F.exists("nodes", lambda n: n["result"])).alias("result"),
        per(use, F.flatten(F.transform("nodes", lambda n: n["numbers"]))).alias("said"), F.col("numbers"), per(citation, wrong).alias("wrong"), "source_ids", per(visual, intact).alias("intact"),
    )
    by_slide = Window.partitionBy("paper_id", "slide_id").orderBy("is", "pos", "ref")  # slides first, then uses as they are listed
    whole = by_slide.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gathered = lambda when, c: F.collect_list(F.when(when, c)).over(whole)
    together = met.withColumns({
        "nth": F.row_number().over(by_slide), "uses": gathered(F.col("is") == use, F.struct("ref", "known", "low", "result", "said")), "cites": gathered(F.col("is") == citation, F.col("ref")),
        "wrongs": gathered((F.col("is") == citation) & (F.col("wrong") > 0), F.struct("ref", "wrong", "source_ids")), "visuals": gathered(F.col("is") == visual, F.struct("kind", "ref", "intact")),
    }).where(F.col("is") == slide)
    names = lambda xs: F.transform(xs, lambda x: x["ref"])
    by_key = F.col("paper_id").isNotNull() & F.col("slide_id").isNotNull()
    supported = F.when(by_key, F.flatten(F.transform("uses", lambda x: x["said"]))).otherwise(F.array().cast(_STRINGS))
    checked = together.select(
        "paper_id", "slide_id", "nth", "evidence_ids", "wrongs", names(F.filter("uses", lambda x: x["known"] == 0)).alias("bad"), F.exists("uses", lambda x: x["result"]).alias("result"),
        names(F.filter("uses", lambda x: x["ref"].isNull() | ~F.coalesce(F.array_contains("cites", x["ref"]), F.lit(False)))).alias("missing"),
        F.flatten(F.transform("uses", lambda x: F.array_repeat(x["ref"], x["low"]))).alias("low"), F.array_sort(F.array_except("numbers", supported)).alias("extra"),
        F.flatten(F.transform("visuals", lambda v: F.transform(v["intact"], lambda i: F.struct(v["kind"].alias("kind"), v["ref"].alias("ref"), i.alias("intact"))))).alias("visual"),
    )
    good, first = F.size("bad") == 0, F.col("nth") == 1  # findings on a slide's evidence as a whole come once, should rows repeat the slide's id
    ids, name = F.col("evidence_ids"), F.col("slide_id")
    found = lambda code, severity, message, evidence=None, sources=None: F.struct((code if isinstance(code, Column) else F.lit(code)).alias("code"), F.lit(severity).alias("severity"), message.alias("message"), (_none() if evidence is None else evidence).alias("evidence"), (_none() if sources is None else sources).alias("sources"))
    some = lambda when, *xs: F.when(when, F.array(*xs))
    differ = F.flatten(F.transform("wrongs", lambda c: F.array_repeat(found("CITATION_SOURCE_MISMATCH", "error", _text(name, " 的 citation source 与 evidence locator 不一致。"), F.array(c["ref"]), F.array_sort(F.array_distinct(c["source_ids"]))), c["wrong"])))
    what = lambda v, asset, table, other: F.when(v["kind"] == "source_asset", asset).when(v["kind"] == "source_table", table).otherwise(other)
    lost = F.transform(F.filter("visual", lambda v: v["intact"].isNull() & (v["kind"] != "conceptual_diagram")), lambda v: found(what(v, "UNKNOWN_SOURCE_ASSET", "UNKNOWN_SOURCE_TABLE", "UNKNOWN_SOURCE_EQUATION"), "error", _text(name, what(v, " 引用了不存在的 source asset ", " 引用了不存在的表格 ", " 引用了不存在的公式 "), v["ref"], "。"), sources=F.array(v["ref"])))
    changed = F.transform(F.filter("visual", lambda v: (v["kind"] == "source_asset") & ~v["intact"]), lambda v: found("SOURCE_ASSET_HASH_MISMATCH", "error", _text(name, " 的源视觉文件缺失或哈希发生变化。"), sources=F.array(v["ref"])))
    made = F.transform(F.filter("visual", lambda v: v["kind"] == "conceptual_diagram"), lambda v: found("GENERATED_EXPERIMENT_VISUAL", "error", _text(name, " 使用 conceptual diagram 表达实验结果，可能被误认为原始证据。"), ids))
    lists = [
        some(first & ~good, found("UNKNOWN_EVIDENCE", "error", _text(name, " 引用了不存在的 evidence ID：", F.array_join("bad", ", "), "。"), F.col("bad"))),
        some(good & by_key & first & (F.size("missing") > 0), found("MISSING_CITATION", "error", _text(name, " 的 evidence 没有完整映射到可见 citation。"), F.col("missing"))),
        F.when(good & by_key & first, differ),
        some((good | ~by_key) & (F.size("extra") > 0), found("UNSUPPORTED_NUMBER", "error", _text(name, " 中的数字 ", F.array_join("extra", ", "), " 未由本页 evidence 支持。"), ids)),
        F.when(good & by_key, F.concat(lost, changed)),
        F.when(good & by_key & F.col("result"), made),
        some(good & by_key & first & (F.size("low") > 0), found("LOW_CONFIDENCE_EVIDENCE", "warning", _text(name, " 的核心信息使用了 low-confidence evidence。"), F.col("low"))),
    ]
    rows = checked.select("paper_id", "slide_id", F.explode(F.flatten(F.array_compact(F.array(*lists)))).alias("f")).select("paper_id", "slide_id", "f.*")
    out = issues(rows, "factual", F.col("code"), F.col("severity"), F.col("message"), _slide(), F.col("evidence"), F.col("sources"))
    if agreeing is not None:
        out = out.unionByName(issues(agreeing.where("n <> 1"), "factual", "PAPER_ID_MISMATCH", "error", F.lit("Slide Spec、Evidence Graph、Paper Structure 与 Visual Manifest 的 paper_id 不一致。")))
    return out


def _under(*tables: DataFrame) -> DataFrame:
    """Tables under each other; columns that one lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def storyline(slides: DataFrame, units: DataFrame, plans: DataFrame) -> DataFrame:
    """Order and content of slides against the plan, stages of the story, repeated claims, declared gaps."""
    s = slides.select("paper_id", F.col("order"), F.col("unit_id").alias("slide_unit"))
    u = units.select("paper_id", F.col("order"), "unit_id")
    moved = s.join(u, ["paper_id", "order"], "full").where("NOT (slide_unit <=> unit_id)").select("paper_id").distinct()
    index = lambda roles: F.coalesce(P.first_of(F.col("role"), F.col("order"), roles), F.lit(NO_INDEX))
    have = units.groupBy("paper_id").agg(*[index(roles).alias(name) for name, roles in STAGES], F.max(F.col("role") == "limitations").alias("limits"))
    papers = slides.select("paper_id").union(plans.select("paper_id")).distinct()  # one without any unit lacks all stages
    have = papers.join(have, "paper_id", "left").select("paper_id", *[F.coalesce(name, F.lit(NO_INDEX)).alias(name) for name, _ in STAGES], F.coalesce("limits", F.lit(False)).alias("limits"))
    absent = have.select("paper_id", F.explode(F.array_compact(F.array(*[F.when(F.col(name) == NO_INDEX, F.lit(name)) for name, _ in STAGES]))).alias("stage"))
    again = slides.withColumn("key", T.claim_key(F.col("main_claim"))).withColumn("before", F.lag("slide_id").over(Window.partitionBy("paper_id", "key").orderBy("order"))).where("before IS NOT NULL")
    pair = slides.join(units.select("paper_id", "unit_id", F.col("question").alias("q"), F.col("main_claim").alias("m"), F.col("evidence_ids").alias("e")), ["paper_id", "unit_id"])
    drift = pair.where("NOT (question <=> q AND main_claim <=> m AND evidence_ids <=> e)")
    gaps = plans.select("paper_id", F.explode("coverage_gaps").alias("gap"))
    return union(
        issues(moved, "storyline", "PLAN_SPEC_ORDER_MISMATCH", "error", F.lit("Slide Spec 与 Presentation Plan 的 unit 顺序不一致。")),
        issues(absent, "storyline", "MISSING_STORYLINE_STAGE", "error", _text("叙事缺少 ", F.col("stage"), " 阶段。")),
        issues(have.where("NOT limits"), "storyline", "MISSING_LIMITATIONS", "warning", F.lit("汇报没有独立的 limitations 页面。")),
        issues(have.where("problem > method OR method > evidence OR evidence > ending"), "storyline", "STORYLINE_ORDER", "error", F.lit("Problem、Method、Evidence 与 Conclusion 的顺序出现倒置。")),
        issues(again, "storyline", "DUPLICATE_MAIN_CLAIM", "warning", _text(F.col("slide_id"), " 与 ", F.col("before"), " 使用了相同 main claim。"), F.array("before", "slide_id")),
        issues(drift, "storyline", "UNIT_CONTENT_DRIFT", "error", _text(F.col("slide_id"), " 与对应 presentation unit 的 question、claim 或 evidence 不一致。"), _slide(), F.col("evidence_ids")),
        issues(gaps, "storyline", "DECLARED_COVERAGE_GAP", "warning", _text("Presentation Plan 明确记录 coverage gap：", F.col("gap"), "。")),
    )


def presentation(slides: DataFrame, units: DataFrame, plans: DataFrame) -> DataFrame:
    """Timing, speaker notes, titles and transitions."""
    spoken = slides.groupBy("paper_id").agg(F.sum("notes_seconds").alias("spec"))
    planned = units.groupBy("paper_id").agg(F.sum("seconds").alias("plan"))
    t = spoken.join(planned, "paper_id", "left").withColumn("plan", F.coalesce("plan", F.lit(0))).join(plans.select("paper_id", "budget"), "paper_id", "left")
    s = slides.withColumn("last", F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("order"))) == 1)
    closing = F.coalesce(*[F.when(F.col("notes_transition").contains(x), True) for x in CLOSING], F.lit(False))
    return union(
        issues(t.where("spec <> plan"), "presentation", "TIMING_DRIFT", "error", F.lit("Slide Spec 与 Presentation Plan 的总讲述时间不一致。")),
        issues(t.where("spec > budget"), "presentation", "TIME_BUDGET_EXCEEDED", "error", F.lit("压缩后的汇报仍超过用户时间预算。")),
        issues(s.where("notes_message <> main_claim"), "presentation", "NOTES_MAIN_MESSAGE_DRIFT", "error", _text(F.col("slide_id"), " 的 speaker notes main message 与页面 main claim 不一致。"), _slide()),
        issues(s.where("notes_purpose <> purpose"), "presentation", "NOTES_PURPOSE_DRIFT", "warning", _text(F.col("slide_id"), " 的 speaker notes purpose 与页面 purpose 不一致。"), _slide()),
        issues(s.where(~T.keyword_overlap(F.concat_ws(" ", "title", "main_claim"), F.col("notes_script"))), "presentation", "SCRIPT_CONTENT_DRIFT", "warning", _text(F.col("slide_id"), " 的讲稿与标题和 main claim 缺少可识别的关键词重合。"), _slide()),
        issues(s.where(T.ends_with_punctuation(F.col("title"))), "presentation", "TITLE_TRAILING_PUNCTUATION", "warning", _text(F.col("slide_id"), " 的短标题包含不必要的结尾标点。"), _slide(), field_path=_text("slides[", (F.col("order") - 1).cast("string"), "].title")),
        issues(s.where(~F.col("last") & F.col("notes_transition").contains("结束")), "presentation", "EARLY_CLOSING_TRANSITION", "warning", _text(F.col("slide_id"), " 在最后一页之前使用了结束型 transition。"), _slide()),
        issues(s.where(F.col("last") & ~closing), "presentation", "MISSING_CLOSING_TRANSITION", "info", _text(F.col("slide_id"), " 的最后 transition 没有明确结束、问答或讨论。"), _slide()),
    )


def semantic(slides: DataFrame, evaluations: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Verdicts on claims, and concepts that are explained too late.

    evaluations(paper_id, slide_id, claim_evidence, claim_evidence_rationale, claim_strength, claim_strength_rationale, evidence_ids);
    dependencies(paper_id, slide_id, concept, rationale, required, prerequisite_slide_ids).
    """
    e, why, how = evaluations, F.col("claim_evidence_rationale"), F.col("claim_strength_rationale")
    pos = slides.select("paper_id", "slide_id", F.col("order").alias("at"))
    need = dependencies.where("required").join(pos, ["paper_id", "slide_id"])
    pre = need.select("paper_id", "slide_id", "concept", "rationale", "at", F.posexplode("prerequisite_slide_ids").alias("p", "pre")).join(pos.select("paper_id", F.col("slide_id").alias("pre"), F.col("at").alias("pre_at")), ["paper_id", "pre"]).where("pre_at >= at")
    late = pre.groupBy("paper_id", "slide_id", "concept", "rationale").agg(F.transform(F.array_sort(F.collect_set(F.struct("p", "pre"))), lambda x: x["pre"]).alias("late"))
    ids = F.col("evidence_ids")
    return union(
        issues(e.where("claim_evidence = 'unsupported'"), "factual", "CLAIM_EVIDENCE_UNSUPPORTED", "error", _text(F.col("slide_id"), " 的 main claim 不能由所列 evidence 推出：", why), _slide(), ids),
        issues(e.where("claim_evidence = 'partially_supported'"), "factual", "CLAIM_EVIDENCE_PARTIAL", "warning", _text(F.col("slide_id"), " 的 main claim 只有部分内容被 evidence 支持：", why), _slide(), ids),
        issues(e.where("claim_evidence = 'insufficient_evidence'"), "factual", "CLAIM_EVIDENCE_INSUFFICIENT", "warning", _text(F.col("slide_id"), " 的 evidence 不足以完成语义判断：", why), _slide(), ids),
        issues(e.where("claim_strength = 'overstated'"), "factual", "CLAIM_STRENGTH_OVERSTATED", "error", _text(F.col("slide_id"), " 的措辞强于证据允许的结论：", how), _slide(), ids),
        issues(e.where("claim_strength = 'understated'"), "factual", "CLAIM_STRENGTH_UNDERSTATED", "info", _text(F.col("slide_id"), " 的措辞可能弱于现有证据：", how), _slide(), ids),
        issues(need.where(F.size("prerequisite_slide_ids") == 0), "storyline", "STORYLINE_PREREQUISITE_MISSING", "warning", _text(F.col("slide_id"), " 使用概念“", F.col("concept"), "”前缺少必要铺垫：", F.col("rationale")), _slide()),
        issues(late, "storyline", "STORYLINE_DEPENDENCY_ORDER", "warning", _text(F.col("slide_id"), " 依赖的概念“", F.col("concept"), "”出现在本页之后或本页：", F.array_join("late", ", "), "。", F.col("rationale")), F.concat(F.array("slide_id"), F.col("late"))),
    )


def deduplicated(found: DataFrame, order: str) -> DataFrame:
    """One issue an id: the last one's values. order: a column that numbers the findings; where it does not tell two apart, their evidence and sources do."""
    w = Window.partitionBy("paper_id", "issue_id").orderBy(F.desc(order), F.desc("evidence_ids"), F.desc("source_ids"))
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def in_order(found: DataFrame, slides: DataFrame, group: str) -> DataFrame:
    """found with a column pos that numbers a paper's findings: by group of rules, by the place of the first slide that a finding names (those that name none come first), by rule, and by id."""
    rule = F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(ACTIONS) for x in (c, k)]), F.col("code"))
    at = slides.select("paper_id", F.col("slide_id").alias("__slide"), F.col("order").alias("__at"))
    placed = found.withColumn("__slide", F.get("slide_ids", 0)).join(at, ["paper_id", "__slide"], "left").withColumn("__rule", rule)
    w = Window.partitionBy("paper_id").orderBy(group, F.asc_nulls_first("__at"), "__rule", "issue_id")
    return placed.withColumn("pos", F.row_number().over(w).cast("long")).drop("__slide", "__at", "__rule")


#: Checks of each group: so many a paper, and so many for each of its slides; a semantic draft adds two factual ones for each evaluation and one on the story for each dependency.
CHECKS = {"factual": (1, 4), "storyline": (5, 1), "visual": (6, 1), "presentation": (3, 5)}


def checks_run(slides: DataFrame, evaluations: DataFrame | None = None, dependencies: DataFrame | None = None) -> DataFrame:
    """(paper_id, category, checks_run): a row for each paper and each category of CHECKS."""
    n = slides.groupBy("paper_id").agg(F.count("*").alias("n"))
    extra = {"factual": F.lit(0), "storyline": F.lit(0)}
    for name, df, each in (("factual", evaluations, 2), ("storyline", dependencies, 1)):
        if df is not None:
            n = n.join(df.groupBy("paper_id").agg((F.count("*") * each).alias(name)), "paper_id", "left")
            extra[name] = F.coalesce(F.col(name), F.lit(0))
    rows = [F.struct(F.lit(c).alias("category"), (F.col("n") * every + once + extra.get(c, F.lit(0))).cast("long").alias("checks_run")) for c, (once, every) in CHECKS.items()]
    return n.select("paper_id", F.inline(F.array(*rows)))


def safe_repairs(slides: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(slides, actions): titles without the punctuation that was found behind them. Nothing else of a slide changes."""
    hit = found.where("code = 'TITLE_TRAILING_PUNCTUATION' AND size(slide_ids) = 1").select("paper_id", F.get("slide_ids", 0).alias("slide_id"), "issue_id")
    after = T.strip_trailing_punctuation(F.col("title"))
    s = slides.join(hit, ["paper_id", "slide_id"], "left").withColumn("after", F.when(F.col("issue_id").isNotNull() & (after != "") & (after != F.col("title")), after))
    actions = s.where("after IS NOT NULL").select("paper_id", "slide_id", "issue_id", F.col("title").alias("before"), "after", repair_id(F.col("issue_id"), F.col("slide_id"), F.col("after")).alias("action_id"))
    return s.withColumn("title", F.coalesce("after", "title")).select(*slides.columns), actions


def authoring_violations(slides: DataFrame, visuals: DataFrame) -> DataFrame:
    """(paper_id, rule, slide_id, detail) of the rules a deck must meet before it is drawn."""
    v = visuals.join(slides.select("paper_id", "slide_id", "layout"), ["paper_id", "slide_id"]) if "layout" in slides.columns else visuals.withColumn("layout", F.lit(None).cast("string"))
    fits = F.lit(True)
    for kind, allowed in TREATMENTS.items():
        fits = fits & ((F.col("kind") != kind) | F.col("treatment").isin(*allowed))
    fits = fits & ((F.col("kind") != "source_asset") | ~F.col("treatment").isin(*NOT_FOR_ASSETS))
    reused = v.where("role <> 'background'").groupBy("paper_id", "source_ref").agg(F.count("*").alias("n"), F.max("slide_id").alias("slide_id")).where("n > 1")
    row = lambda df, rule, detail: df.select("paper_id", F.lit(rule).alias("rule"), "slide_id", detail.alias("detail"))
    lines = slides.select("paper_id", "slide_id", F.explode("body").alias("line"))
    return union(
        row(lines.where(F.length("line") > 240), "body_line", F.length("line").cast("string")),
        row(slides.where(~F.size("body").between(1, 5)), "body_lines", F.size("body").cast("string")),
        row(slides.where(F.size(T.title_problems(F.col("title"))) > 0), "title", F.array_join(T.title_problems(F.col("title")), ",")),
        row(v.where(~fits), "treatment", F.concat_ws("/", "kind", "treatment")),
        row(reused, "reused_source", F.col("source_ref")),
        row(v.where("kind = 'source_table' AND layout NOT IN ('table_focus', 'comparison')"), "table_layout", F.col("layout")),
        row(v.where("kind = 'source_equation' AND layout <> 'equation_focus'"), "equation_layout", F.col("layout")),
    )


def text_box_findings(boxes: DataFrame, width: float | Column, height: float | Column) -> DataFrame:
    """First problem box and first overlapping pair of each slide. boxes(paper_id, slide_id, i, text, x, y, cx, cy, font, auto_fit) in EMU and points."""
    from ..functions.geometry import EMU_PER_INCH, intersection_ratio, looks_overfull

    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    boxes = boxes.withColumn("wide", as_col(width)).withColumn("high", as_col(height))
    out = (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("cx") > F.col("wide")) | (F.col("y") + F.col("cy") > F.col("high"))
    full = looks_overfull(F.col("text"), F.col("cx") / EMU_PER_INCH, F.col("cy") / EMU_PER_INCH, F.col("font"), F.col("auto_fit"))
    b = boxes.withColumn("code", F.when(out, "OUT_OF_BOUNDS_TEXT").when(F.col("font") < 8, "UNREADABLY_SMALL_FONT").when(full, "LIKELY_TEXT_OVERFLOW")).where("code IS NOT NULL")
    first = b.groupBy("paper_id", "slide_id").agg(F.min_by("code", "i").alias("code"))
    keep = ["x", "y", "cx", "cy", "text", "i", "high"]
    left, right = (boxes.select("paper_id", "slide_id", *[F.col(k).alias(f"{s}{k}") for k in keep]) for s in "ab")
    hit = left.join(right, ["paper_id", "slide_id"]).where("ai < bi").where(~((F.col("ay") > F.col("ahigh") * 0.84) & (F.col("by") > F.col("bhigh") * 0.84)) & ~F.col("atext").rlike(r"^\d{2}$") & ~F.col("btext").rlike(r"^\d{2}$")).where(intersection_ratio("a", "b") > 0.65)
    message = F.when(F.col("code") == "OUT_OF_BOUNDS_TEXT", " 存在超出画布的文本框。").when(F.col("code") == "UNREADABLY_SMALL_FONT", " 存在小于 8pt 的文本。").otherwise(" 的文本密度可能超过文本框容量。")
    return issues(first, "visual", F.col("code"), F.when(F.col("code") == "OUT_OF_BOUNDS_TEXT", "error").otherwise("warning"), _text(F.col("slide_id"), message), _slide()).unionByName(issues(hit.select("paper_id", "slide_id").distinct(), "visual", "TEXT_BOX_OVERLAP", "error", _text(F.col("slide_id"), " 存在大面积重叠的文本框。"), _slide()))


def package_findings(packages: DataFrame) -> DataFrame:
    """packages(paper_id, width, height, problem): those that cannot be read, and those whose slides are not 16:9."""
    p = packages.withColumn("good", F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & (F.abs(F.try_divide(F.col("width"), F.col("height")) - F.lit(16 / 9)) <= 0.01), F.lit(False)))
    return union(
        issues(p.where("problem IS NOT NULL"), "visual", "INVALID_PPTX_PACKAGE", "error", _text("无法检查 PPTX 包：", F.col("problem"))),
        issues(p.where("problem IS NULL AND NOT good"), "visual", "INVALID_SLIDE_ASPECT", "error", F.lit("PPTX 画布不是有效的 16:9 尺寸。")),
    )


def missing_tables(boxes: DataFrame, visuals: DataFrame) -> DataFrame:
    """Slides of a package that should show a source table but hold no native one. boxes(paper_id, slide_id, has_table), a row for each slide at least."""
    bare = boxes.groupBy("paper_id", "slide_id").agg(F.max("has_table").alias("has")).where("NOT has")
    wanted = bare.join(visuals.where("kind = 'source_table'").select("paper_id", "slide_id"), ["paper_id", "slide_id"], "left_semi")
    return issues(wanted, "visual", "NATIVE_TABLE_MISSING", "error", _text(F.col("slide_id"), " 应包含可编辑 native table，但 PPTX 中未找到。"), _slide())


# Fixed values that results depend on: the least size of a preview, and how far its sides may be off 16:9.
PREVIEW_WIDTH, PREVIEW_HEIGHT, PREVIEW_ASPECT = 960, 540, 0.03


def part_findings(parts: DataFrame, slides: DataFrame) -> DataFrame:
    """parts(paper_id, n_slides, n_notes) of packages that can be read, against slides(paper_id, slide_id): wrong numbers of slides and of notes."""
    n = parts.join(slides.groupBy("paper_id").agg(F.count("*").alias("n")), "paper_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    number = lambda c: F.col(c).cast("string")
    return union(
        issues(n.where("n_slides <> n"), "visual", "SLIDE_COUNT_MISMATCH", "error", _text("PPTX 含 ", number("n_slides"), " 页，但 Slide Spec 定义 ", number("n"), " 页。")),
        issues(n.where("n_notes <> n"), "visual", "MISSING_NOTES_PART", "error", _text("PPTX 只有 ", number("n_notes"), " 个 notes part，预期 ", number("n"), " 个。")),
    )


def preview_findings(previews: DataFrame, slides: DataFrame) -> DataFrame:
    """previews(paper_id, name, w, h), w and h null where the file is no PNG, against slides(paper_id, slide_id, order): decks without any preview, wrong
    numbers of them, unreadable ones, and small or badly shaped ones. The k-th name of a deck belongs to its k-th slide; names beyond the slides are only counted."""
    k = lambda by: F.row_number().over(Window.partitionBy("paper_id").orderBy(by))
    s = slides.select("paper_id", "slide_id", k("order").alias("k"))
    counts = s.groupBy("paper_id").agg(F.count("*").alias("n")).join(previews.groupBy("paper_id").agg(F.count("*").alias("have")), "paper_id", "left")
    each = previews.select("paper_id", "name", "w", "h", k("name").alias("k")).join(s, ["paper_id", "k"])
    unreadable = F.col("w").isNull() | F.col("h").isNull()
    poor = (F.col("w") < PREVIEW_WIDTH) | (F.col("h") < PREVIEW_HEIGHT) | (F.abs(F.try_divide("w", "h") - F.lit(16 / 9)) > PREVIEW_ASPECT)
    number = lambda c: F.col(c).cast("string")
    return union(
        issues(counts.where("have IS NULL"), "visual", "PREVIEW_NOT_RENDERED", "warning", F.lit("未生成逐页 PNG，因此视觉 QA 只完成了结构检查。")),
        issues(counts.where("have <> n"), "visual", "PREVIEW_COUNT_MISMATCH", "error", _text("预览目录含 ", number("have"), " 张 PNG，预期 ", number("n"), " 张。")),
        issues(each.where(unreadable), "visual", "INVALID_PREVIEW_IMAGE", "error", _text(F.col("name"), " 不是可读取的 PNG。"), _slide()),
        issues(each.where(~unreadable & poor), "visual", "LOW_QUALITY_PREVIEW", "warning", _text(F.col("name"), " 的分辨率或宽高比不足：", number("w"), "x", number("h"), "。"), _slide()),
    )


def render_failures(failures: DataFrame) -> DataFrame:
    """failures(paper_id, reason): decks of which no pictures could be made."""
    return issues(failures, "visual", "RENDER_INSPECT_UNAVAILABLE", "error", _text("无法完成 PPTX → PDF → PNG：", F.col("reason")))
