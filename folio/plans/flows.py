"""The flows a user runs: papers to structure, claims to evidence, drafts to plans, decks to quality reports, specs to elements.

Each is a plan over DataFrames of any number of papers; nothing runs until a result is written, but for gates and for run_qa, which stores the findings of each group of rules. Drafts come from a provider: anything
with a method `draft(name) -> DataFrame`; JsonDrafts reads them from files. Online providers and PDF text extraction are outside: their results
enter as tables; `sinks.packages` writes what render_deck gives.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import authoring, elements, evidence, guards, incremental, parse, planning, qa, relations, reports, scope
from ..sources.files import read_artifacts
from ..sources.shared import stored


#: Groups of rules that read a slide's title, the one thing that is repaired.
OF_TITLES = ("factual", "presentation")
#: Slide size in EMU where no package says another.
WIDTH, HEIGHT = 12192000, 6858000


class GateError(ValueError):
    """Strict flows raise this with the first violations."""


class Provider(Protocol):
    def draft(self, name: str) -> DataFrame: ...


class JsonDrafts:
    """Drafts from JSON files by name, each with the schema that is expected; unknown fields are an error."""

    def __init__(self, spark: SparkSession, paths: dict[str, str], schemas: dict):
        self.spark, self.paths, self.schemas = spark, paths, schemas

    def draft(self, name: str) -> DataFrame:
        return read_artifacts(self.spark, self.paths[name], self.schemas[name])


def gate(violations: DataFrame, strict: bool, what: str) -> DataFrame:
    if strict and (bad := violations.limit(5).collect()):
        raise GateError(f"{what}: " + "; ".join(str(r.asDict()) for r in bad))
    return violations


def parse_papers(tex: DataFrame, pages: DataFrame | None = None) -> dict[str, DataFrame]:
    """tex(paper_id, text), pages(paper_id, page, text) -> sections, figures, tables, equations, paragraphs.

    Sections come from LaTeX where a paper has any; paragraphs of both sources are kept, LaTeX first, and those of pages lose a
    section that the paper does not have.
    """
    sections, paragraphs = parse.sections(tex), parse.paragraphs(tex).withColumn("source", F.lit("latex"))
    if pages is not None:
        lines = parse.page_lines(pages)
        own = lines.where("heading").select("paper_id", "section_id", F.col("text").alias("title"), F.struct("page", "pos").alias("at"))
        own = own.join(sections.select("paper_id").distinct(), "paper_id", "left_anti").withColumn("order", F.row_number().over(relations.Window.partitionBy("paper_id").orderBy("at")) - 1)
        sections = sections.unionByName(own.select("paper_id", "section_id", "order", F.lit(1).alias("level"), "title", F.lit(None).cast("string").alias("parent"), F.lit("").alias("body")))
        p = parse.numbered(lines.where("NOT heading").withColumn("at", F.struct("page", "pos")), "paper_id", "at", "para_pdf_", 5, "paragraph_id")
        known = sections.select("paper_id", F.col("section_id"), F.lit(True).alias("known"))
        p = p.join(known, ["paper_id", "section_id"], "left").select("paper_id", "paragraph_id", "text", F.when(F.col("known"), F.col("section_id")).alias("section_id"), F.lit("pdf").alias("source"))
        paragraphs = paragraphs.unionByName(p)
    return {"metadata": parse.metadata(tex), "sections": sections, "paragraphs": paragraphs, "figures": parse.figures(tex), "tables": parse.tables(tex), "equations": parse.equations(tex)}


def source_catalog(paper: dict[str, DataFrame]) -> DataFrame:
    """(paper_id, source_id, kind, text) of everything that evidence may cite."""
    either = lambda *c: F.coalesce(*[F.when(F.length(x) > 0, F.col(x)) for x in c])
    kinds = (("paragraph", "paragraphs", "paragraph_id", F.col("text")), ("figure", "figures", "figure_id", either("caption", "file", "figure_id")), ("table", "tables", "table_id", F.concat_ws("\n", "caption", "latex")), ("equation", "equations", "equation_id", F.col("latex")))
    parts = [paper[t].select("paper_id", F.col(i).alias("source_id"), F.lit(k).alias("kind"), x.alias("text")) for k, t, i, x in kinds]
    return qa.union(*parts)


def build_evidence(claims: DataFrame, refs: DataFrame, links: DataFrame, catalog: DataFrame, strict: bool = True) -> dict[str, DataFrame]:
    bad = gate(evidence.violations(claims, refs, catalog), strict, "evidence")
    nodes = evidence.nodes(claims, refs)
    edges = evidence.edges(links, nodes)
    gate(edges.where("source IS NULL OR target IS NULL"), strict, "relations")
    gate(relations.duplicate_keys(nodes, "paper_id", "id"), strict, "evidence ids")
    return {"nodes": nodes, "edges": edges, "answers": evidence.answers(nodes), "violations": bad}


def build_plan(units: DataFrame, nodes: DataFrame, mode: str, budget: int | None = None, strict: bool = True) -> dict[str, DataFrame]:
    """units(paper_id, unit_id, order, role, main_claim, evidence_ids, importance, seconds) -> units kept, coverage gaps, violations."""
    from ..functions import numbers as N
    from ..functions import text as T

    cited = units.select("paper_id", "unit_id", F.explode("evidence_ids").alias("id"))
    unknown = relations.dangling(cited, nodes, ("paper_id", "paper_id"), ("id", "id")).select("paper_id", F.lit("unknown_evidence").alias("rule"), "unit_id")
    text = cited.join(nodes.select("paper_id", "id", "claim"), ["paper_id", "id"]).groupBy("paper_id", "unit_id").agg(F.concat_ws(" ", F.collect_list("claim")).alias("support"))
    extra = units.join(text, ["paper_id", "unit_id"], "left").where(F.size(N.missing_numbers(F.col("main_claim"), F.coalesce("support", F.lit("")))) > 0)
    bad = qa.union(planning.sequence_violations(units).select("paper_id", "rule", F.lit(None).cast("string").alias("unit_id")), unknown, extra.select("paper_id", F.lit("unsupported_number").alias("rule"), "unit_id"))
    if mode == "paper-reading":
        bad = bad.unionByName(units.where(T.own_voice(F.col("main_claim"))).select("paper_id", F.lit("own_voice").alias("rule"), "unit_id"))
    gate(bad, strict, "plan")
    gaps = planning.coverage_gaps(units.select("paper_id", "role"), planning.coverage_labels(units.sparkSession, mode))
    kept = units.select("paper_id", "unit_id", F.col("order").alias("new_order"))
    if budget:
        g = F.coalesce(*[F.when(F.col("role").isin(*roles), F.lit(k)) for k, roles in enumerate(planning.ROLE_GROUPS)])
        u = planning.required_units(units.withColumn("g", g), "paper_id", "g", "importance", "order")
        over = units.groupBy("paper_id").agg(F.sum("seconds").alias("total")).where(F.col("total") > budget).select("paper_id")
        gate(planning.narrative_minimum(u, "paper_id", "seconds", F.lit(budget)).join(over, "paper_id", "left_semi"), strict, "time budget is below the narrative minimum")
        kept = planning.select_within_budget(u, "paper_id", "unit_id", "importance", "order", "seconds", F.lit(budget))
    return {"units": kept, "gaps": gaps, "violations": bad}


def build_spec(units: DataFrame, slides: DataFrame, visuals: DataFrame, known: DataFrame, chinese_first: bool = True, strict: bool = True) -> dict[str, DataFrame]:
    """Slides that passed all gates of `authoring`, with their notes and outline as texts; titles come from the first slide."""
    bad = gate(authoring.spec_violations(units, slides, visuals, known, chinese_first), strict, "slide specification")
    titles = slides.groupBy("paper_id").agg(F.min_by("title", "order").alias("title"))
    return {"slides": slides, "visuals": visuals, "violations": bad, "notes": reports.speaker_notes(slides, titles), "outline": reports.outline(slides, titles)}


def run_qa(deck: dict[str, DataFrame], max_iterations: int = 1) -> dict[str, DataFrame]:
    """deck: slides, units, plans, citations, visuals, nodes, known, and optionally evaluations and dependencies, boxes, packages (whose sizes hold for the boxes),
    artifacts(paper_id, artifact, names), the paper that each artifact of a deck names, or parts, previews and failures as in `qa`.

    Findings of all rules, numbered in the order of a report (pos); titles are repaired and checked again, at most max_iterations times, until nothing is left to repair. categories say how many checks
    were run for each paper. Evaluations with a column pos have to be the deck's slides in their order, with their evidence and slides that exist; else nothing is judged.
    """
    if not 0 <= max_iterations <= 5:
        raise ValueError("max_iterations must lie between 0 and 5")

    agreeing = deck["artifacts"].groupBy("paper_id").agg(F.countDistinct("names").alias("n")) if "artifacts" in deck else None

    def boxes(slides: DataFrame) -> DataFrame:
        own, size = deck["boxes"], (F.lit(WIDTH), F.lit(HEIGHT))
        if "packages" in deck:
            own = own.join(deck["packages"].select("paper_id", F.col("width").alias("slide_w"), F.col("height").alias("slide_h")), "paper_id", "left")
            size = tuple(F.when(F.col(c) > 0, F.col(c)).otherwise(other) for c, other in (("slide_w", WIDTH), ("slide_h", HEIGHT)))
        return qa.text_box_findings(own, *size)

    rules = {
        "factual": lambda s: qa.factual(s, deck["citations"], deck["visuals"], deck["nodes"], deck["known"], agreeing),
        "storyline": lambda s: qa.storyline(s, deck["units"], deck["plans"]),
        "presentation": lambda s: qa.presentation(s, deck["units"], deck["plans"]),
    }
    if "evaluations" in deck:
        rules["semantic"] = lambda s: qa.semantic(s, deck["evaluations"], deck["dependencies"])
    if "boxes" in deck:
        rules["boxes"] = boxes
        if "has_table" in deck["boxes"].columns:
            rules["tables"] = lambda s: qa.missing_tables(deck["boxes"], deck["visuals"])
    for name, rule in (("packages", lambda s: qa.package_findings(deck["packages"])), ("parts", lambda s: qa.part_findings(deck["parts"], s)), ("previews", lambda s: qa.preview_findings(deck["previews"], s)), ("failures", lambda s: qa.render_failures(deck["failures"]))):
        if name in deck:
            rules[name] = rule

    slides, actions = deck["slides"], None
    if "evaluations" in deck and "pos" in deck["evaluations"].columns:
        gate(scope.scope_problems(slides, deck["evaluations"], deck["dependencies"], deck["nodes"]), True, "semantic draft")
    held = {name: stored(rule(slides), f"qa-{name}") for name, rule in rules.items()}  # each group of rules is evaluated once
    every_issue = lambda: qa.union(*[df.withColumn("group", F.lit(k)) for k, df in enumerate(held.values())])
    for _ in range(max_iterations):
        repaired, did = qa.safe_repairs(slides, held["presentation"])
        did = stored(did, "qa-actions")
        if did.isEmpty():
            break
        slides, actions = stored(repaired, "qa-slides"), did if actions is None else actions.unionByName(did)
        held |= {name: stored(rules[name](slides), f"qa-{name}") for name in OF_TITLES}  # what a title does not change is not looked at again
    issues = every_issue()
    if actions is not None and {"pos"} <= set(deck["citations"].columns) & set(deck["visuals"].columns):
        before, after = (guards.evidence_signatures(x, deck["visuals"], deck["citations"]) for x in (deck["slides"], slides))
        gate(guards.changed_evidence(before, after), True, "a repair changed evidence")
    issues = qa.in_order(qa.deduplicated(issues, "group"), slides, "group").drop("group")
    every = qa.checks_run(slides, deck.get("evaluations"), deck.get("dependencies"))
    status = every.join(issues, ["paper_id", "category"], "left").groupBy("paper_id", "category").agg(reports.status_of().alias("status"), F.count("severity").alias("n_issues"), F.first("checks_run").alias("checks_run"))
    return {"issues": issues, "categories": status, "slides": slides, "actions": actions if actions is not None else qa.safe_repairs(slides, issues)[1].limit(0), "status": status.groupBy("paper_id").agg(F.when(F.max(F.col("status") == "fail"), "fail").when(F.max(F.col("status") == "pass_with_warnings"), "pass_with_warnings").otherwise("pass").alias("status"))}


def render_deck(slides: DataFrame, visuals: DataFrame, tables: DataFrame, equations: DataFrame, numbers: list[int] | None = None) -> dict[str, DataFrame]:
    """Everything a writer needs: elements (see `elements`) and the notes of each slide. visuals without cells and formulas get them from
    tables(paper_id, table_id, latex) and equations(paper_id, equation_id, latex). numbers: of the slides to render; a paper that lacks one of them is an error."""
    from ..functions import formulas
    from ..functions import tables as tables_of

    if numbers is not None:
        have = F.collect_set(F.when(F.col("number").isin(*numbers), F.col("number").cast("long")))
        lacking = slides.groupBy("paper_id").agg(F.array_sort(F.array_except(F.array(*[F.lit(int(n)).cast("long") for n in numbers]), have)).alias("missing"))
        gate(lacking.where(F.size("missing") > 0), True, "unknown slides")
        slides = slides.where(F.col("number").isin(*numbers))
    used = visuals.join(slides.select("paper_id", "slide_id"), ["paper_id", "slide_id"], "left_semi")
    refs = used.select("paper_id", "source_ref", "kind").distinct()
    ref = lambda df, i, kind: df.withColumnRenamed(i, "source_ref").join(refs.where(F.col("kind") == kind).drop("kind"), ["paper_id", "source_ref"], "left_semi")
    cells = ref(tables, "table_id", "source_table").select("paper_id", "source_ref", F.lit("source_table").alias("kind"), tables_of.tabular_rows(F.col("latex")).alias("cells"))
    written = ref(equations, "equation_id", "source_equation").select("paper_id", "source_ref", F.lit("source_equation").alias("kind"), formulas.readable(F.col("latex")).alias("formula"))
    own = [c for c in used.columns if c not in ("cells", "formula")]
    used = used.select(*own).join(cells, ["paper_id", "source_ref", "kind"], "left").join(written, ["paper_id", "source_ref", "kind"], "left")
    return {"elements": elements.slide_elements(slides, used), "notes": elements.note_texts(slides)}


def run_build(steps: DataFrame, files: DataFrame, wanted: DataFrame, handlers: dict, resume_from: str | None = None) -> list[tuple[str, str]]:
    """Runs what a build of any number of papers still has to do, step by step, and returns (step, "skip" or "run").

    handlers: for each step a function of the DataFrame of run ids that need it; it writes its step's artifacts. steps, files and wanted as in `incremental`.
    A step is called once for all papers that need it. With resume_from, files that steps before it should have left must be there."""
    lost = incremental.missing_artifacts(wanted, files)
    if resume_from is not None:
        steps, problems = incremental.resumed(steps, lost, wanted.select("run_id", F.lit(resume_from).alias("resume_from")))
        gate(problems, True, f"cannot resume from {resume_from}")
    plan = incremental.to_do(steps, lost, wanted)
    need = {r["step"] for r in plan.where("action = 'run'").select("step").distinct().collect()}  # at most one row a step
    done = []
    for step in incremental.STEPS:
        if step in need:
            handlers[step](plan.where((F.col("step") == step) & (F.col("action") == "run")).select("run_id"))
        done.append((step, "run" if step in need else "skip"))
    return done
