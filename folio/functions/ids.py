"""Ids and fingerprints derived from contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold


def content_id(prefix: str, *parts: Column, separator: str = "\0", length: int = 12) -> Column:
    """prefix and the first hex digits of the SHA-256 of the parts, joined by a separator that texts do not hold."""
    joined = F.concat(*[x for p in parts for x in (F.lit(separator), p)][1:])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def evidence_id(claim: Column, source_ids: Column) -> Column:
    return content_id("evidence_", fold(F.trim(claim)), F.array_join(source_ids, "\0"))


def unit_id(role: Column, claim: Column, evidence_ids: Column) -> Column:
    return content_id("unit_", role, fold(F.trim(claim)), F.array_join(evidence_ids, "\0"))


def issue_id(category: Column, code: Column, message: Column, slide_ids: Column, field_path: Column) -> Column:
    return content_id("qa_", category, code, message, F.array_join(F.coalesce(slide_ids, F.array().cast("array<string>")), ","), F.coalesce(field_path, F.lit("")), separator="\x1f")


def repair_id(issue: Column, slide: Column, after: Column) -> Column:
    return content_id("repair_", issue, slide, after, separator="\x1f")


def combined_fingerprint(ids_and_digests: Column) -> Column:
    """SHA-256 over (id, digest) structs, sorted by id."""
    return F.sha2(F.array_join(F.transform(F.array_sort(ids_and_digests), lambda x: F.concat(x["id"], x["digest"])), ""), 256)
