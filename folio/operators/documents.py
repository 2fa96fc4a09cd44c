"""Strict validation of nested JSON documents: a tree of nodes says what a document must be, and is turned into one expression over its VARIANT.

A document is parsed once and walked within its row, so nothing is exploded or shuffled but the problems that are found.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegralType, MapType, NumericType, StructType

PROBLEM = "array<struct<path:string,problem:string>>"
#: What schema_of_variant says of a scalar, or begins with, for each name used in problems.
KINDS = {"STRING": "text", "BIGINT": "whole number", "DECIMAL": "number", "DOUBLE": "number", "BOOLEAN": "boolean", "VOID": "null", "OBJECT": "object", "ARRAY": "array"}


@dataclass(frozen=True)
class Text:
    """A text with something besides white space in it (unless `empty`), one of `among` if that is given."""

    among: tuple[str, ...] = ()
    empty: bool = False
    maybe: bool = False
    kinds = ("text",)


@dataclass(frozen=True)
class Whole:
    least: int | None = None
    maybe: bool = False
    kinds = ("whole number",)


@dataclass(frozen=True)
class Number:
    maybe: bool = False
    kinds = ("number", "whole number")


@dataclass(frozen=True)
class Flag:
    only: bool | None = None
    maybe: bool = False
    kinds = ("boolean",)


@dataclass(frozen=True)
class Anything:
    maybe: bool = True
    kinds = ()


@dataclass(frozen=True)
class Items:
    """An array of `item`, at least `least` of them. Fields named in `unique` differ between its objects; `numbered` is a field that counts them from 1."""

    item: object
    least: int = 0
    unique: tuple[str, ...] = ()
    numbered: str | None = None
    maybe: bool = False
    kinds = ("array",)


@dataclass(frozen=True)
class Object:
    """An object with these fields and no others (unless `open`). rules: (field, problem, holds) with holds a function of the object's VARIANT; where it gives false, the field has the problem."""

    fields: dict = field(hash=False)
    open: bool = False
    rules: tuple[tuple[str, str, Callable[[Column], Column]], ...] = ()
    maybe: bool = False
    kinds = ("object",)


def maybe(node):
    """The node, or null, or nothing at all."""
    return replace(node, maybe=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def child(v: Column, name: str, kind: str = "variant") -> Column:
    """A field of an object; SQL null if it is not there, or not of that kind."""
    return F.try_variant_get(v, f"$.{name}", kind)


def items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def kind_of(v: Column) -> Column:
    """The kind of a VARIANT by its name in KINDS; 'nothing' for SQL null."""
    word = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.when(v.isNull(), "nothing").otherwise(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), word), F.lower(word)))


def _found(path: Column, problem: Column | str) -> Column:
    return F.array(F.struct(path.alias("path"), (problem if isinstance(problem, Column) else F.lit(problem)).alias("problem")))


def _none() -> Column:
    return F.array().cast(PROBLEM)


def _when(bad: Column, path: Column, problem: Column | str) -> Column:
    return F.when(bad, _found(path, problem)).otherwise(_none())


def _scalar(v: Column, node, path: Column) -> Column:
    if isinstance(node, Text):
        text = F.try_variant_get(v, "$", "string")
        if node.among:
            return _when(~text.isin(*node.among), path, "must be one of " + ", ".join(node.among))
        return _none() if node.empty else _when(F.trim(F.translate(text, "\t\n\r", "   ")) == "", path, "must not be empty")
    if isinstance(node, Whole) and node.least is not None:
        return _when(F.try_variant_get(v, "$", "decimal(38,0)") < node.least, path, f"must be {node.least} or more")
    if isinstance(node, Flag) and node.only is not None:
        return _when(F.try_variant_get(v, "$", "boolean") != node.only, path, f"must be {str(node.only).lower()}")
    return _none()


def _fields(v: Column, node: Object) -> Column:
    """The known fields of an object as a struct of VARIANTs, taken out together; SQL null if v is no object."""
    if not node.fields:
        return F.try_variant_get(v, "$", "map<string,variant>")
    return F.try_variant_get(v, "$", "struct<" + ",".join(f"`{name.replace('`', '``')}`:variant" for name in node.fields) + ">")


def _object(v: Column, fields: Column, node: Object, path: Column) -> Column:
    parts = [problems(fields.getField(name), sub, F.concat(path, F.lit(f".{name}"))) for name, sub in node.fields.items()]
    if not node.open:
        strange = F.array_except(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")), F.array(*map(F.lit, node.fields)))
        parts.append(F.transform(F.array_sort(strange), lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("unknown field").alias("problem"))))
    parts += [_when(~holds(v), F.concat(path, F.lit(f".{name}")), problem) for name, problem, holds in node.rules]
    return F.concat(*parts) if parts else _none()


def _repeats(xs: Column, name: str, at: Callable[[Column], Column]) -> Column:
    """Objects whose field has a value that an earlier one has: equal values stand side by side once sorted."""
    ranked = F.array_sort(F.transform(xs, lambda x, i: F.struct(child(x, name, "string").alias("value"), i.alias("i"))))
    twice = let(ranked, lambda s: F.filter(s, lambda e, j: e["value"].isNotNull() & (F.get(s, j - 1)["value"] == e["value"])))
    return F.transform(twice, lambda e: F.struct(F.concat(at(e["i"]), F.lit(f".{name}")).alias("path"), F.lit("repeated").alias("problem")))


def _array(xs: Column, node: Items, path: Column) -> Column:
    at = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
    parts = [F.flatten(F.transform(xs, lambda x, i: problems(x, node.item, at(i))))]
    if node.least:
        parts.append(_when(F.size(xs) < node.least, path, f"must have {node.least} or more"))
    parts += [_repeats(xs, name, at) for name in node.unique]
    if node.numbered:
        name = node.numbered
        wrong = lambda x, i: F.when(child(x, name, "long") != i + 1, F.struct(F.concat(at(i), F.lit(f".{name}")).alias("path"), F.concat(F.lit("must be "), (i + 1).cast("string")).alias("problem")))
        parts.append(F.array_compact(F.transform(xs, wrong)))
    return F.concat(*parts)


def _is(schema: Column, kinds: tuple[str, ...]) -> Column:
    """Whether what schema_of_variant says of a scalar is one of these kinds."""
    words = [w for w, kind in KINDS.items() if kind in kinds]
    tests = [schema.startswith(w) if w == "DECIMAL" else schema == w for w in words]
    return F.coalesce(reduce(or_, tests), F.lit(False))


def problems(v: Column, node, path: Column) -> Column:
    """The problems of a VARIANT as array<struct<path, problem>>. A value of the wrong kind has that problem alone, and nothing below it is looked at.

    v is used several times, so it has to be cheap: a variable of a lambda or a field of a struct. What kind a value is instead is asked only of those that are not what they must be."""

    def otherwise(k: Column) -> Column:
        out = F.when(k == "nothing", _none() if node.maybe else _found(path, "missing"))
        if node.maybe:
            out = out.when(k == "null", _none())
        return out.otherwise(_found(path, F.concat(F.lit(f"must be {' or '.join(node.kinds)}, is "), k)) if node.kinds else _none())

    other = let(kind_of(v), otherwise)
    if isinstance(node, Object):
        return let(_fields(v, node), lambda o: F.when(o.isNotNull(), F.coalesce(_object(v, o, node, path), _none())).otherwise(other))
    if isinstance(node, Items):
        return let(items(v), lambda xs: F.when(xs.isNotNull(), F.coalesce(_array(xs, node, path), _none())).otherwise(other))
    if not node.kinds:
        return _none() if node.maybe else F.when(v.isNull(), _found(path, "missing")).otherwise(_none())
    return F.when(_is(F.schema_of_variant(v), node.kinds), F.coalesce(_scalar(v, node, path), _none())).otherwise(other)


def validate(documents: DataFrame, node, json: str = "json", root: str = "$") -> DataFrame:
    """(the other columns, path, problem): a row for each problem of each document, in the order of the tree.

    A null text is 'missing', text that is not JSON (or repeats a key, which VARIANT does not allow) 'not JSON'. Good documents give no rows. The walk is one expression:
    a document is parsed once, and stays in its task.
    """
    others = [F.col(f"`{c}`") for c in documents.columns if c != json]
    text, v = F.col(f"`{json}`"), F.try_parse_json(F.col(f"`{json}`"))
    found = let(v, lambda x: F.when(text.isNull(), _found(F.lit(root), "missing")).when(x.isNull(), _found(F.lit(root), "not JSON")).otherwise(problems(x, node, F.lit(root))))
    return documents.select(*others, F.inline(found))


def node_of(kind: DataType, nullable: bool = False):
    """The tree that a Spark type stands for: every field known at any depth, nullable ones may be null or absent."""
    if isinstance(kind, StructType):
        node = Object({f.name: node_of(f.dataType, f.nullable) for f in kind.fields})
    elif isinstance(kind, ArrayType):
        node = Items(node_of(kind.elementType, kind.containsNull))
    elif isinstance(kind, MapType):
        node = Object({}, open=True)
    elif isinstance(kind, BooleanType):
        node = Flag()
    elif isinstance(kind, IntegralType):
        node = Whole()
    elif isinstance(kind, NumericType):
        node = Number()
    else:
        node = Text(empty=True)
    return maybe(node) if nullable else node


def strict_schema(schema):
    """A JSON schema (as dicts and lists) that asks for everything it knows, at every depth: no defaults, all properties required, no others."""
    if isinstance(schema, list):
        return [strict_schema(x) for x in schema]
    if not isinstance(schema, dict):
        return schema
    named = ("properties", "$defs", "definitions")  # their keys are names of the user's, not words of the schema
    out = {k: {name: strict_schema(x) for name, x in v.items()} if k in named and isinstance(v, dict) else strict_schema(v) for k, v in schema.items() if k != "default"}
    if isinstance(out.get("properties"), dict):
        out |= {"required": list(out["properties"]), "additionalProperties": False}
    return out


# Names that a slide specification may use.
SPEC_LAYOUTS = ("minimal_text", "visual_left_text_right", "text_left_visual_right", "full_visual", "comparison", "equation_focus", "table_focus", "process")
SPEC_VISUALS = ("source_asset", "source_table", "source_equation", "conceptual_diagram")
SPEC_THEMES = ("conference-minimal", "group-meeting")


def _labels_fit(v: Column) -> Column:
    labels = child(v, "table_column_labels")
    return labels.isNull() | F.is_variant_null(labels) | (child(v, "kind", "string") == "source_table")


def _seconds_add_up(v: Column) -> Column:
    each = F.transform(items(child(v, "slides")), lambda s: F.coalesce(F.try_variant_get(s, "$.speaker_notes.estimated_seconds", "long"), F.lit(0)))
    return F.coalesce(child(v, "estimated_total_seconds", "long") == F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(True))


def slide_spec() -> Object:
    """The tree of a slide specification as a renderer takes it. Fields that a renderer does not look at are left open."""
    visual = Object(
        {"visual_id": Text(), "source_ref": Text(), "kind": Text(SPEC_VISUALS), "table_column_labels": Items(Text(), 1, maybe=True), "treatment": Text(maybe=True), "caption": Text(maybe=True)},
        rules=(("table_column_labels", "only tables have column labels", _labels_fit),),
    )
    notes = Object({k: Text() for k in ("purpose", "main_message", "script", "visual_guidance", "transition")} | {"estimated_seconds": Whole(1)})
    slide = Object(
        {k: Text() for k in ("slide_id", "unit_id", "section", "purpose", "question", "title", "main_claim", "takeaway")}
        | {"order": Whole(1), "layout": Text(SPEC_LAYOUTS), "body": Items(Text(), 1), "citations": Items(Anything(), 1), "visuals": Items(visual), "speaker_notes": notes, "evidence_ids": Items(Text(), maybe=True), "technical_title": Text(maybe=True)}
    )
    presentation = Object({"language": Text(("zh-CN",)), "terminology_mode": Text(("bilingual",))} | {k: Flag(True) for k in ("preserve_source_visual_language", "translate_generic_labels", "translate_speaker_notes")})
    return Object(
        {
            "schema_version": Text(("1.1",)), "paper_id": Text(), "theme": Text(SPEC_THEMES), "title": Text(), "language": Text(("zh-CN",)), "language_profile": Text(("zh_cn_bilingual_terms",)), "presentation": presentation,
            "slides": Items(slide, 1, unique=("slide_id", "unit_id"), numbered="order"), "estimated_total_seconds": Whole(1), "mode": Text(maybe=True),
        },
        rules=(("estimated_total_seconds", "is not the sum of the notes' seconds", _seconds_add_up),),
    )
