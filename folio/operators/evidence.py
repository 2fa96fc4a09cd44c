"""Evidence graphs from drafted claims: grounding, ids, edges, answers by category, citation labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.ids import evidence_id
from .relations import grounded

# Fixed values that results depend on.
CATEGORIES = ("problem", "importance", "existing_approaches", "gap", "central_insight", "contributions", "method", "design_rationale", "experiment_findings", "ablation_findings", "limitations", "audience_takeaways")
NUMERIC_TYPES = ("experimental_result", "ablation_result")


def nodes(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """claims(paper_id, claim_index, category, type, claim, confidence) and refs(paper_id, claim_index, pos, source_id, excerpt) -> nodes with ids."""
    r = refs.groupBy("paper_id", "claim_index").agg(F.array_sort(F.collect_list(F.struct("pos", "source_id", "excerpt"))).alias("r"))
    n = claims.join(r, ["paper_id", "claim_index"], "left").withColumn("r", F.coalesce("r", F.array().cast(r.schema["r"].dataType)))
    ids, excerpts = F.transform("r", lambda x: x["source_id"]), F.transform("r", lambda x: x["excerpt"])
    return n.select("paper_id", "claim_index", evidence_id(F.col("claim"), ids).alias("id"), "category", "type", "claim", "confidence", ids.alias("source_ids"), excerpts.alias("excerpts"))


def violations(claims: DataFrame, refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(paper_id, claim_index, problem): unknown sources, excerpts that are not in theirs, numbers of results that no cited source holds."""
    c = catalog.select("paper_id", "source_id", "text")
    keyed = lambda df: df.withColumn("source_id", F.concat_ws("\0", "paper_id", "source_id"))
    bad = grounded(keyed(refs), keyed(c)).where("problem IS NOT NULL").select("paper_id", "claim_index", "problem")
    texts = refs.join(c, ["paper_id", "source_id"]).groupBy("paper_id", "claim_index").agg(F.concat_ws(" ", F.collect_list("text")).alias("t"))
    numeric = claims.where(F.col("type").isin(*NUMERIC_TYPES)).join(texts, ["paper_id", "claim_index"], "left").withColumn("m", N.missing_numbers(F.col("claim"), F.coalesce("t", F.lit(""))))
    return bad.unionByName(numeric.where(F.size("m") > 0).select("paper_id", "claim_index", F.concat(F.lit("unsupported numbers: "), F.array_join("m", ", ")).alias("problem")))


def edges(relations: DataFrame, found: DataFrame) -> DataFrame:
    """Relations by claim index -> (paper_id, source, target, relation); null ends where an index is out of range."""
    a = found.select("paper_id", F.col("claim_index").alias("source_claim_index"), F.col("id").alias("source"))
    b = found.select("paper_id", F.col("claim_index").alias("target_claim_index"), F.col("id").alias("target"))
    return relations.join(a, ["paper_id", "source_claim_index"], "left").join(b, ["paper_id", "target_claim_index"], "left").select("paper_id", "source", "target", "relation")


def answers(found: DataFrame) -> DataFrame:
    """Every category of every paper with its evidence in claim order; without any it is insufficient."""
    every = found.select("paper_id").distinct().select("paper_id", F.explode(F.array(*map(F.lit, CATEGORIES))).alias("category"))
    got = found.groupBy("paper_id", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("claim_index", "id"))), lambda x: x["id"]).alias("evidence_ids"))
    out = every.join(got, ["paper_id", "category"], "left").withColumn("evidence_ids", F.coalesce("evidence_ids", F.array().cast("array<string>")))
    return out.withColumn("status", F.when(F.size("evidence_ids") == 0, "insufficient_evidence").otherwise("grounded"))


def citation_labels(sources: DataFrame) -> DataFrame:
    """sources(paper_id, evidence_id, pos, source_id, section, page, figure, table, equation) -> (paper_id, evidence_id, display_text)."""
    part = F.concat_ws(", ", "section", F.concat(F.lit("p. "), F.col("page").cast("string")), *[F.concat(F.lit(f"{n} "), F.col(c)) for n, c in (("Figure", "figure"), ("Table", "table"), ("Equation", "equation"))])
    s = sources.withColumn("label", F.when(part == "", F.col("source_id")).otherwise(part))
    labels = F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"])
    return s.groupBy("paper_id", "evidence_id").agg(F.array_join(F.array_distinct(labels), "; ").alias("display_text"))
