"""Queries over texts: numbers, grounding, keys, ids, titles, lines, markup."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import ids as I
from ..functions import numbers as N
from ..functions import text as T
from ..operators import relations as R


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


# SQL spellings of the functions
def sql_fold(x):
    return f"replace(lower({x}), 'ß', 'ss')"


def sql_collapse(x):
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def sql_norm(x):
    return sql_fold(sql_collapse(x))


def sql_key(x):
    return sql_fold(rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', '', 'g')")


_RAW = r"unnest(regexp_extract_all(text, '\d+\.\d+|\d+|(?:^|[^\p{L}\p{N}_.])\.\d+'))"
_BARE = r"regexp_extract(raw, '(\.?\d.*)$', 1)"
_LEAD = rf"CASE WHEN {_BARE} LIKE '.%' THEN '0' || {_BARE} ELSE regexp_replace({_BARE}, '^0+([0-9])', '\1') END"
_NUMS = rf"SELECT DISTINCT doc_id, source, CASE WHEN {_LEAD} LIKE '%.%' THEN regexp_replace({_LEAD}, '\.?0+$', '') ELSE {_LEAD} END AS key FROM (SELECT doc_id, source, {_RAW} AS raw FROM documents)"


def number_keys(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(N.number_keys(F.col("text"))).alias("key"))


def missing_numbers(spark, d):
    """Values that no earlier document of the same source holds: the first document of a (source, value) is the one that lacks support."""
    keys = _t(spark, d, "documents").select("doc_id", "source", F.explode(N.number_keys(F.col("text"))).alias("key"))
    return keys.groupBy("source", "key").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("missing"))


def excerpt_grounding(spark, d):
    e = _t(spark, d, "benchmark").select(F.col("item_id").alias("excerpt_id"), F.col("text").alias("excerpt"))
    t = _t(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "text")
    return R.contained(e, t).select(F.col("excerpt_id").alias("item_id"), F.col("source_id").alias("doc_id"))


def claim_key_duplicates(spark, d):
    return R.previous_duplicate(_t(spark, d, "documents"), T.claim_key(F.col("text")), "doc_id", "doc_id").select("doc_id", F.col("previous").alias("previous_id"))


def cjk_gate(spark, d):
    p = _t(spark, d, "pages").select("page_id", F.stack(F.lit(2), F.lit("url"), F.col("url"), F.lit("title"), F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("field", "value"))
    return p.where(~T.contains_cjk(F.col("value"))).select("page_id", "field")


def slugs(spark, d):
    return _t(spark, d, "part").select("p_partkey", T.slug(F.concat("p_name", F.lit(" / "), "p_type", F.lit("!"))).alias("slug"))


def content_ids(spark, d):
    x = _t(spark, d, "documents")
    return x.select("doc_id", I.evidence_id(F.col("text"), F.array("source", "lang")).alias("evidence_id"), I.unit_id(F.col("source"), F.col("text"), F.array("lang")).alias("unit_id"), I.issue_id(F.col("lang"), F.col("source"), F.col("text"), F.array(F.col("doc_id").cast("string")), F.lit(None).cast("string")).alias("issue_id"))


def keyword_overlap(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = _t(spark, d, "conversations").withColumn("before", F.lag("text").over(w)).where("before IS NOT NULL")
    return c.select("conv_id", "turn", T.keyword_overlap(F.col("before"), F.col("text")).alias("overlap"))


def trailing_punctuation(spark, d):
    x = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return x.where(T.ends_with_punctuation(F.col("line"))).select("doc_id", "line_no", T.strip_trailing_punctuation(F.col("line")).alias("repaired"))


def title_repair(spark, d):
    x = _t(spark, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    after = T.strip_trailing_punctuation(F.col("title"))
    return x.select("page_id", F.col("title").alias("before"), after.alias("after"), F.array_join(T.title_problems(F.col("title")), ",").alias("problems"), ((after != F.col("title")) & (after != "")).alias("repaired"))


def html_structure(spark, d):
    x = _t(spark, d, "pages")
    count = lambda tag: F.size(F.regexp_extract_all("html", F.lit(f"(?s)(<{tag}[ >])"), F.lit(1))).alias(f"n_{tag}")
    return x.select("page_id", F.regexp_extract("html", "(?s)<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "(?s)<h1>([^<]*)</h1>", 1).alias("h1"), *[count(t) for t in ("p", "li", "nav", "article")])


def line_paragraphs(spark, d):
    x = _t(spark, d, "documents").select("doc_id", F.posexplode(T.heading_lines(F.col("text"))).alias("pos", "line")).where(~T.is_heading(F.col("line")))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return x.select("doc_id", F.format_string("para_pdf_%05d", n).alias("paragraph_id"), F.length("line").alias("n_chars"))


def heading_carry(spark, d):
    c = _t(spark, d, "conversations")
    return R.carry_forward(c, "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")), "section").select("conv_id", "turn", "section")


def voice_gate(spark, d):
    x = _t(spark, d, "part").withColumn("claim", F.concat(F.when(F.col("p_size") % 5 == 0, "Here We Propose ").when(F.col("p_size") % 7 == 0, "OUR METHOD ").otherwise("They show "), "p_name"))
    return x.where(T.own_voice(F.col("claim"))).select("p_partkey", "claim")


_TEX_PARTS = (r"\section{", "p_name", r"} self-\textbf{\emph{", "p_brand", r"}}s hold 5\% ", "#", r"of \emph{", "p_type", "}~\\citep[see][p.~3]{a,b} % note\nEnd{.}")
_TEX_MIDDLE = (r"\textit{a{b}c}", r"\ref{x}\label{y}", r"{\bf deep {\it deeper}}", r"100\% sure\\ ")


def _tex():
    middle = F.element_at(F.array(*map(F.lit, _TEX_MIDDLE)), F.col("p_size") % len(_TEX_MIDDLE) + 1)
    return F.concat(*[middle if x == "#" else F.col(x) if x.startswith("p_") else F.lit(x) for x in _TEX_PARTS])


_TEX_SQL = " || ".join(f"CASE p_size % {len(_TEX_MIDDLE)} " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(_TEX_MIDDLE)) + " END" if x == "#" else x if x.startswith("p_") else "'" + x.replace("\n", "' || chr(10) || '") + "'" for x in _TEX_PARTS)


def latex_text(spark, d):
    """Paragraphs and cells made of part rows, cleaned; paragraphs differ by size in nesting, commands within words, escaped signs, comments and citations."""
    x = _t(spark, d, "part").withColumn("tex", _tex()).withColumn("cell", F.concat(F.lit("\\textbf{\\emph{"), "p_name", F.lit("}} \\hline $"), "p_size", F.lit("$ \\& 7\\%")))
    return x.select("p_partkey", T.clean_latex(F.col("tex")).alias("paragraph"), T.clean_cell(F.col("cell")).alias("cell"))


def overfull_lines(spark, d):
    x = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return x.where(G.looks_overfull(F.col("line"), F.lit(4.2), F.lit(0.9), F.lit(14.0))).select("doc_id", "line_no", F.length("line").alias("n_chars"))


def json_fields(spark, d):
    return _t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.array_join(F.json_object_keys("props"), ",").alias("keys"))


_DOC_KEY = "coalesce(CAST(doc_id AS VARCHAR), '')"
QUERIES = {f.__name__: f for f in (number_keys, missing_numbers, excerpt_grounding, claim_key_duplicates, cjk_gate, slugs, content_ids, keyword_overlap, trailing_punctuation, title_repair, html_structure, line_paragraphs, heading_carry, voice_gate, latex_text, overfull_lines, json_fields)}
ORACLES = {
    "number_keys": f"SELECT doc_id, key FROM ({_NUMS})",
    "missing_numbers": f"WITH k AS ({_NUMS}), f AS (SELECT source, key, min(doc_id) AS doc_id FROM k GROUP BY ALL) SELECT doc_id, string_agg(key, ',' ORDER BY key) AS missing FROM f GROUP BY doc_id",
    "excerpt_grounding": f"WITH b AS (SELECT item_id, {sql_norm('text')} AS n FROM benchmark), d AS (SELECT doc_id, {sql_norm('text')} AS h FROM documents) SELECT item_id, doc_id FROM b JOIN d ON contains(h, n)",
    "claim_key_duplicates": f"SELECT doc_id, previous_id FROM (SELECT doc_id, lag(doc_id) OVER (PARTITION BY {sql_key('text')} ORDER BY doc_id) AS previous_id FROM documents) WHERE previous_id IS NOT NULL",
    "cjk_gate": r"SELECT page_id, field FROM (SELECT page_id, 'url' AS field, url AS value FROM pages UNION ALL SELECT page_id, 'title', regexp_extract(html, '<title>([^<]*)</title>', 1) FROM pages) WHERE NOT regexp_matches(value, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]')",
    "slugs": "SELECT p_partkey, regexp_replace(left(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type || '!'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 48), '-+$', '') AS slug FROM part",
    "content_ids": f"SELECT doc_id, 'evidence_' || left(sha256({sql_fold('trim(text)')} || chr(0) || source || chr(0) || lang), 12) AS evidence_id, 'unit_' || left(sha256(source || chr(0) || {sql_fold('trim(text)')} || chr(0) || lang), 12) AS unit_id, 'qa_' || left(sha256(lang || chr(31) || source || chr(31) || text || chr(31) || CAST(doc_id AS VARCHAR) || chr(31)), 12) AS issue_id FROM documents",
    "keyword_overlap": rf"""WITH c AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, turn, list_has_any(regexp_extract_all({sql_fold('before')}, '[a-z][a-z0-9-]{{2,}}|\d+(?:\.\d+)?|[\x{{4e00}}-\x{{9fff}}]{{2,}}'), regexp_extract_all({sql_fold('text')}, '[a-z][a-z0-9-]{{2,}}|\d+(?:\.\d+)?|[\x{{4e00}}-\x{{9fff}}]{{2,}}')) AS overlap FROM c WHERE before IS NOT NULL""",
    "trailing_punctuation": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(regexp_replace(regexp_replace(line, '\s+$', ''), '[。！？!?；;：:]+$', ''), '\s+$', '') AS repaired FROM l WHERE regexp_matches(regexp_replace(line, '\s+$', ''), '[。！？!?；;：:]$')""",
    "title_repair": rf"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS before FROM pages),
a AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(before, '\s+$', ''), '[。！？!?；;：:]+$', ''), '\s+$', '') AS after FROM p)
SELECT page_id, before, after, array_to_string(list_filter([CASE WHEN regexp_replace({sql_fold('trim(before)')}, '\.+$', '') IN {T.GENERIC_TITLES} THEN 'generic' END, CASE WHEN before LIKE '%.' AND length(before) < 90 THEN 'trailing_period' END,
  CASE WHEN regexp_matches(before, '[—;|→]') THEN 'punctuation' END, CASE WHEN length(before) > 110 THEN 'too_long' END], lambda x: x IS NOT NULL), ',') AS problems, after <> before AND after <> '' AS repaired FROM a""",
    "html_structure": "SELECT page_id, regexp_extract(html, '(?s)<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>([^<]*)</h1>', 1) AS h1, " + ", ".join(f"CAST(len(regexp_extract_all(html, '<{t}[ >]')) AS INTEGER) AS n_{t}" for t in ("p", "li", "nav", "article")) + " FROM pages",
    "line_paragraphs": rf"""WITH l AS (SELECT doc_id, {sql_collapse('unnest(string_split(text, chr(10)))')} AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT * FROM l WHERE line <> '' AND NOT (regexp_matches(line, '^(?:\d+(?:\.\d+)*\s+)?[A-Z][A-Za-z0-9 ,:&/\-]{{2,80}}$') AND len(string_split(line, ' ')) <= 10))
SELECT doc_id, 'para_pdf_' || lpad(CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS VARCHAR), 5, '0') AS paragraph_id, CAST(length(line) AS INTEGER) AS n_chars FROM k""",
    "heading_carry": "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations",
    "voice_gate": "SELECT * FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'Here We Propose ' WHEN p_size % 7 = 0 THEN 'OUR METHOD ' ELSE 'They show ' END || p_name AS claim FROM part) WHERE regexp_matches(lower(claim), 'we propose|our method')",
    "latex_text": rf"""WITH t AS (SELECT *, {_TEX_SQL} AS tex FROM part),
c AS (SELECT *, replace(regexp_replace(replace(tex, '\%', chr(1)), '%[^\n]*', '', 'g'), chr(1), '%') AS bare FROM t),
k AS (SELECT *, regexp_replace(regexp_replace(bare, '\\(?:cite\w*|ref|label|eqref)\*?(?:\[[^\]]*\])*\{{[^{{}}]*\}}', '', 'g'), '\\[A-Za-z@]+\*?(?:\[[^\]]*\])?|[{{}}]', '', 'g') AS plain FROM c)
SELECT p_partkey, trim(regexp_replace(replace(plain, '~', ' '), '\s+', ' ', 'g')) AS paragraph, trim(p_name || ' ' || p_size || ' & 7%') AS cell FROM k""",
    "overfull_lines": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(length(line) AS INTEGER) AS n_chars FROM l WHERE ceil(length(line) * 0.55 / greatest(1.0, CAST(4.2 AS DOUBLE) * 72 / 14)) * 14 * 1.28 / 72 > 0.9 * 1.15",
    "json_fields": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, array_to_string(json_keys(props), ',') AS keys FROM events",
}
