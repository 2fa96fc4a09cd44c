"""Validation of nested documents against a plain recursion, and strict reading."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from folio.operators import documents as D
from folio.sources import files


def spec(**changes):
    slide = lambda i: {
        **{k: f"{k} {i}" for k in ("slide_id", "unit_id", "section", "purpose", "question", "title", "main_claim", "takeaway")}, "order": i, "layout": "process", "body": ["a", "b"], "citations": [{"any": 1}],
        "visuals": [{"visual_id": "v", "source_ref": "r", "kind": "source_table", "table_column_labels": ["x"]}, {"visual_id": "w", "source_ref": "r", "kind": "source_asset", "table_column_labels": None}],
        "speaker_notes": {**{k: "t" for k in ("purpose", "main_message", "script", "visual_guidance", "transition")}, "estimated_seconds": 10 * i},
    }
    p = {"language": "zh-CN", "terminology_mode": "bilingual", "preserve_source_visual_language": True, "translate_generic_labels": True, "translate_speaker_notes": True}
    return {"schema_version": "1.1", "paper_id": "p", "theme": "group-meeting", "title": "t", "language": "zh-CN", "language_profile": "zh_cn_bilingual_terms", "presentation": p, "slides": [slide(1), slide(2), slide(3)], "estimated_total_seconds": 60}


def put(doc, path, value=None, drop=False):
    at = doc
    for k in path[:-1]:
        at = at[k]
    if drop:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return doc


CASES = {
    "good": (lambda d: d, set()),
    "null": (lambda d: None, {("$", "missing")}),
    "text": (lambda d: "{", {("$", "not JSON")}),
    "array": (lambda d: [d], {("$", "must be object, is array")}),
    "deep unknown": (lambda d: put(d, ["slides", 1, "visuals", 0, "colour"], {"x": {}}), {("$.slides[1].visuals[0].colour", "unknown field")}),
    "deep empty": (lambda d: put(d, ["slides", 2, "speaker_notes", "script"], " \n\t"), {("$.slides[2].speaker_notes.script", "must not be empty")}),
    "deep kind": (lambda d: put(d, ["slides", 0, "visuals", 1, "kind"], "photo"), {("$.slides[0].visuals[1].kind", "must be one of " + ", ".join(D.SPEC_VISUALS))}),
    "deep missing": (lambda d: put(d, ["slides", 0, "speaker_notes", "transition"], drop=True), {("$.slides[0].speaker_notes.transition", "missing")}),
    "null is not absent": (lambda d: put(d, ["slides", 0, "title"], None), {("$.slides[0].title", "must be text, is null")}),
    "seconds as text": (lambda d: put(d, ["slides", 0, "speaker_notes", "estimated_seconds"], "ten"), {("$.slides[0].speaker_notes.estimated_seconds", "must be whole number, is text"), ("$.estimated_total_seconds", "is not the sum of the notes' seconds")}),
    "seconds in parts": (lambda d: put(d, ["slides", 0, "speaker_notes", "estimated_seconds"], 9.5), {("$.slides[0].speaker_notes.estimated_seconds", "must be whole number, is number"), ("$.estimated_total_seconds", "is not the sum of the notes' seconds")}),
    "no seconds": (lambda d: put(put(d, ["slides", 0, "speaker_notes", "estimated_seconds"], 0), ["estimated_total_seconds"], 50), {("$.slides[0].speaker_notes.estimated_seconds", "must be 1 or more")}),
    "order": (lambda d: put(d, ["slides", 1, "order"], 3), {("$.slides[1].order", "must be 2")}),
    "repeated": (lambda d: put(put(d, ["slides", 2, "slide_id"], "slide_id 1"), ["slides", 1, "unit_id"], "unit_id 1"), {("$.slides[2].slide_id", "repeated"), ("$.slides[1].unit_id", "repeated")}),
    "no slides": (lambda d: put(put(d, ["slides"], []), ["estimated_total_seconds"], 1), {("$.slides", "must have 1 or more"), ("$.estimated_total_seconds", "is not the sum of the notes' seconds")}),
    "slides an object": (lambda d: put(d, ["slides"], {}), {("$.slides", "must be array, is object")}),
    "a slide a text": (lambda d: put(put(d, ["slides", 2], "x"), ["estimated_total_seconds"], 30), {("$.slides[2]", "must be object, is text")}),
    "body": (lambda d: put(d, ["slides", 0, "body"], ["a", "", 5]), {("$.slides[0].body[1]", "must not be empty"), ("$.slides[0].body[2]", "must be text, is whole number")}),
    "labels": (lambda d: put(d, ["slides", 0, "visuals", 1, "table_column_labels"], [""]), {("$.slides[0].visuals[1].table_column_labels", "only tables have column labels"), ("$.slides[0].visuals[1].table_column_labels[0]", "must not be empty")}),
    "flags": (lambda d: put(put(d, ["presentation", "translate_generic_labels"], False), ["language"], "en"), {("$.presentation.translate_generic_labels", "must be true"), ("$.language", "must be one of zh-CN")}),
}


def test_problems_at_any_depth(spark):
    rows = [(name, made if isinstance(made := change(spec()), str) or made is None else json.dumps(made)) for name, (change, _) in CASES.items()]
    found = {}
    for r in D.validate(spark.createDataFrame(rows, "name string, json string"), D.slide_spec()).collect():
        found.setdefault(r["name"], []).append((r["path"], r["problem"]))
    for name, (_, want) in CASES.items():
        assert sorted(found.get(name, [])) == sorted(want), name


def test_validation_moves_nothing(spark):
    plan = D.validate(spark.createDataFrame([("a", "{}")], "name string, json string"), D.slide_spec())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_a_long_list_with_repeats(spark):
    doc = json.dumps({"xs": [{"id": f"i{k % 4999}"} for k in range(5000)]})
    node = D.Object({"xs": D.Items(D.Object({"id": D.Text()}), unique=("id",))})
    assert [(r["path"], r["problem"]) for r in D.validate(spark.createDataFrame([(1, doc)], "k int, json string"), node).collect()] == [("$.xs[4999].id", "repeated")]


def test_repeated_keys_are_not_json(spark):
    got = D.validate(spark.createDataFrame([(1, '{"a":1,"a":2}')], "k int, json string"), D.Object({"a": D.Whole()})).collect()
    assert [tuple(r) for r in got] == [(1, "$", "not JSON")]


def test_trees_of_types(spark):
    kind = StructType([StructField("a", LongType(), False), StructField("b", ArrayType(StructType([StructField("c", StringType())]), False))])
    docs = [(1, '{"a":1}'), (2, '{"a":null,"b":[{"c":null},{"d":1}]}'), (3, '{"b":[null]}'), (4, '{"a":1,"b":[{"c":2}]}')]
    got = {tuple(r) for r in D.validate(spark.createDataFrame(docs, "k int, json string"), D.node_of(kind)).collect()}
    assert got == {(2, "$.a", "must be whole number, is null"), (2, "$.b[1].d", "unknown field"), (3, "$.a", "missing"), (3, "$.b[0]", "must be object, is null"), (4, "$.b[0].c", "must be text, is whole number")}


def test_artifacts_are_read_strictly_at_any_depth(spark, tmp_path):
    kind = StructType([StructField("a", LongType()), StructField("b", ArrayType(StructType([StructField("c", StringType())])))])
    (tmp_path / "good.json").write_text('{"a": 1,\n "b": [{"c": "x"}]}')
    assert files.read_artifacts(spark, str(tmp_path), kind).first()["b"][0]["c"] == "x"
    (tmp_path / "bad.json").write_text('{"a": 1, "b": [{"c": "x", "d": 2}]}')
    with pytest.raises(files.ArtifactError, match=r"b\[0\]\.d: unknown field"):
        files.read_artifacts(spark, str(tmp_path), kind)


def test_strict_schema():
    given = {"type": "object", "properties": {"default": {"type": "string", "default": "x"}, "b": {"type": "array", "items": {"properties": {"c": {"default": 1}}, "required": []}}}, "$defs": {"d": {"properties": {}}}, "default": {}}
    assert D.strict_schema(given) == {
        "type": "object", "properties": {"default": {"type": "string"}, "b": {"type": "array", "items": {"properties": {"c": {}}, "required": ["c"], "additionalProperties": False}}},
        "$defs": {"d": {"properties": {}, "required": [], "additionalProperties": False}}, "required": ["default", "b"], "additionalProperties": False,
    }
    assert D.strict_schema([1, "x"]) == [1, "x"]


def test_empty_tables(spark):
    assert D.validate(spark.createDataFrame([], "k int, json string"), D.slide_spec()).isEmpty()
    assert D.validate(spark.range(1).select(F.lit("{}").alias("json")), D.Object({})).isEmpty()


def test_names_with_dots_and_signs(spark):
    node = D.Object({"a.b": D.Whole(), "c`d": D.Object({"e f": D.Text()})})
    docs = [(1, '{"a.b":1,"c`d":{"e f":"x"}}'), (2, '{"a.b":"1","c`d":{"e f":""}}')]
    assert [tuple(r) for r in D.validate(spark.createDataFrame(docs, "k int, json string"), node).collect()] == [(2, "$.a.b", "must be whole number, is text"), (2, "$.c`d.e f", "must not be empty")]


def test_fields_are_taken_out_together(spark):
    of = lambda names: str(D.problems(F.col("v"), D.Object({n: D.Text(empty=True) for n in names}), F.lit("$"))).count("variant_get")
    assert of("abcdef") == of("a")
