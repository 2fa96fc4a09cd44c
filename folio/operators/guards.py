"""What a repair must not touch, canonical JSON for fingerprints, contexts for drafts, and checks of options, themes and spec rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from .incremental import STEPS

# Fixed values that results depend on.
THEMES = ("conference-minimal", "group-meeting")
THEME_TEXTS = ("fontFamily", "equationFontFamily", "background", "surface", "text", "muted", "accent", "accentSoft", "secondary", "warning")


def sorted_fields(value: Column, kind) -> Column:
    """value with the fields of all its structs, at any depth, in the order of their names; entries of maps by key."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[sorted_fields(value[f.name], f.dataType).alias(f.name) for f in fields]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: sorted_fields(x, kind.elementType)) if _nested(kind.elementType) else value
    if isinstance(kind, MapType):
        entries = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.struct(k.alias("key"), sorted_fields(value[k], kind.valueType).alias("value")))
        return F.map_from_entries(entries)
    return value


def _nested(kind) -> bool:
    return isinstance(kind, StructType | MapType) or (isinstance(kind, ArrayType) and _nested(kind.elementType))


def canonical_json(df: DataFrame, *columns: str) -> Column:
    """Compact JSON of these columns of df (all by default), keys sorted at every depth and nulls written, so that equal rows have equal texts."""
    kept = StructType([f for f in df.schema.fields if not columns or f.name in columns])
    whole = F.struct(*[F.col(f"`{f.name}`") for f in kept.fields])
    return F.to_json(sorted_fields(whole, kept), {"ignoreNullFields": "false"})


def evidence_signatures(slides: DataFrame, visuals: DataFrame, citations: DataFrame) -> DataFrame:
    """(paper_id, signature): SHA-256 over what carries the evidence of each deck: of every slide in order its evidence ids, citations and visuals.

    slides(paper_id, slide_id, order, evidence_ids), visuals(paper_id, slide_id, pos, kind, source_ref, treatment), citations(paper_id, slide_id, pos, ...).
    Rows are digested before they meet: what is gathered for a deck is one digest a slide."""
    keys = ["paper_id", "slide_id"]

    def digests(df: DataFrame, columns: list[str], name: str) -> DataFrame:
        return df.select(*keys, F.struct("pos", F.unhex(F.sha2(canonical_json(df, *columns), 256)).alias("d")).alias(name))

    def folded(name: str) -> Column:
        all_of = F.array_join(F.transform(F.array_sort(F.collect_list(name)), lambda x: F.lower(F.hex(x["d"]))), "")
        return F.when(F.count(name) > 0, F.sha2(all_of, 256)).otherwise("").alias(name)

    cited = digests(citations, [c for c in citations.columns if c not in (*keys, "pos")], "cited")
    seen = digests(visuals, ["kind", "source_ref", "treatment"], "seen")
    s = slides.select(*keys, F.struct("order", F.to_json(F.struct("evidence_ids")).alias("ids")).alias("slide"))
    rows = s.unionByName(cited, allowMissingColumns=True).unionByName(seen, allowMissingColumns=True)  # grouped instead of joined: tables that are dealt out by paper already are not shuffled again
    each = rows.groupBy(*keys).agg(F.collect_list("slide").alias("slides"), folded("cited"), folded("seen")).select(*keys, "cited", "seen", F.explode("slides").alias("slide"))
    digest = F.sha2(F.concat_ws("\0", "slide_id", "slide.ids", "cited", "seen"), 256)
    deck = each.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("slide.order", digest.alias("d")))).alias("all"))
    return deck.select("paper_id", F.sha2(F.array_join(F.transform("all", lambda x: x["d"]), ""), 256).alias("signature"))


def changed_evidence(before: DataFrame, after: DataFrame) -> DataFrame:
    """Papers whose evidence signatures differ, or that only one side knows."""
    b, a = before.withColumnRenamed("signature", "before"), after.withColumnRenamed("signature", "after")
    return b.join(a, "paper_id", "full").where("NOT (before <=> after)")


def option_problems(options: DataFrame) -> DataFrame:
    """options(run_id, theme, resume_from, semantic_qa, has_provider) -> (run_id, problem): themes and steps that do not exist, and a semantic check without provider or the reverse."""
    rules = (
        (~F.coalesce(F.col("theme").isin(*THEMES), F.lit(False)), "theme must be " + " or ".join(THEMES)),
        (F.col("resume_from").isNotNull() & ~F.col("resume_from").isin(*STEPS), "resume_from must be one of: " + ", ".join(STEPS)),
        (~F.col("semantic_qa").eqNullSafe(F.col("has_provider")), "semantic_qa and its provider must be enabled together"),
    )
    found = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for bad, text in rules]))
    return options.select("run_id", F.explode(found).alias("problem"))


def read_theme(text: str, requested: str, font: str | None = None) -> dict:
    """The tokens of a theme file: its name must be the one that was asked for, its texts not empty, and it must name fonts to fall back to. font: takes the family's place."""
    theme = json.loads(text)
    if not isinstance(theme, dict):
        raise ValueError(f"theme {requested} must be a JSON object")
    if theme.get("name") != requested:
        raise ValueError(f"the theme file's name is not {requested}")
    for key in THEME_TEXTS:
        if not isinstance(theme.get(key), str) or not theme[key].strip():
            raise ValueError(f"theme {requested}: {key} must be a text that is not empty")
    others = theme.get("fontFallbacks")
    if not isinstance(others, list) or not others or not all(isinstance(x, str) and x.strip() for x in others):
        raise ValueError(f"theme {requested}: fontFallbacks must name fonts")
    return theme | {"fontFamily": font.strip()} if font and font.strip() else theme


def foreign_inputs(specs: DataFrame, **inputs: DataFrame) -> DataFrame:
    """(paper_id, artifact): papers of specs that an input which must accompany them does not hold."""
    papers, out = specs.select("paper_id").distinct(), None
    for name, df in inputs.items():
        lost = papers.join(df.select("paper_id").distinct(), "paper_id", "left_anti").select("paper_id", F.lit(name).alias("artifact"))
        out = lost if out is None else out.unionByName(lost)
    return out


def draft_contexts(papers: DataFrame, **tables: DataFrame) -> DataFrame:
    """(paper_id, context): one JSON document a paper, its own columns first and then each table's rows, in the order of their column `pos`, under the table's name.

    What is gathered is what a draft is written from: the rows of one paper."""
    out = papers.select("paper_id", F.struct("*").alias("own"))
    names = []
    for name, df in tables.items():
        row = F.struct(*[c for c in df.columns if c not in ("paper_id", "pos")])
        listed = df.groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json(row, {"ignoreNullFields": "false"}).alias("row")))), lambda x: x["row"]).alias(name))
        out = out.join(listed, "paper_id", "left")
        names.append(name)
    own = F.regexp_replace(F.to_json("own", {"ignoreNullFields": "false"}), r"\}$", "")
    parts = [F.concat(F.lit(f',"{n}":['), F.array_join(F.coalesce(F.col(n), F.array().cast("array<string>")), ","), F.lit("]")) for n in names]
    return out.select("paper_id", F.concat(own, *parts, F.lit("}")).alias("context"))


def draft_problems(drafts: DataFrame, wanted: DataFrame) -> DataFrame:
    """drafts and wanted(paper_id, mode, language_profile) -> (paper_id, field, wanted, given): drafts that were made for another mode or language profile than was asked for, or that nobody asked for or made."""
    fields = ("mode", "language_profile")
    b = wanted.select("paper_id", *[F.col(c).alias(f"w_{c}") for c in fields]).join(drafts.select("paper_id", *fields), "paper_id", "full")
    rows = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"w_{c}")), F.struct(F.lit(c).alias("field"), F.col(f"w_{c}").alias("wanted"), F.col(c).alias("given"))) for c in fields]))
    return b.select("paper_id", F.inline(rows))
