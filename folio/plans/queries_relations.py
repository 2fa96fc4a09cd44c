"""Queries over keys, orders, plans, issues and layouts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import planning as P
from ..operators import relations as R
from ..operators import reports as V


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def catalog_union(spark, d):
    c = R.catalog(("document", _t(spark, d, "documents"), F.concat(F.lit("d"), F.col("doc_id")), F.col("text")), ("page", _t(spark, d, "pages"), F.concat(F.lit("p"), F.col("page_id")), F.col("html")), ("passage", _t(spark, d, "benchmark"), F.concat(F.lit("b"), F.col("item_id")), F.col("text")), ("turn", _t(spark, d, "conversations"), F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), F.col("turn")), F.col("text")))
    return c.select("source_id", "kind", F.length("text").alias("n_chars"))


def dangling_refs(spark, d):
    a = R.dangling(_t(spark, d, "orders"), _t(spark, d, "lineitem"), ("o_orderkey", "l_orderkey")).select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"))
    b = R.dangling(_t(spark, d, "documents"), _t(spark, d, "labels"), ("doc_id", "doc_id")).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"))
    return a.unionByName(b)


def duplicate_keys(spark, d):
    return R.duplicate_keys(_t(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


def order_contiguity(spark, d):
    return R.order_violations(_t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "expected")


def section_parents(spark, d):
    x = _t(spark, d, "events").select("user_id", "event_id", (F.floor("value").cast("long") % 4 + 1).alias("level"))
    return R.section_parents(x, "user_id", "event_id", "level", "event_id", 4).select("event_id", "level", "parent")


def sequence_rules(spark, d):
    """Conversations as plans: the system turn opens, answers end, and the first user turn comes before the first answer."""
    c = _t(spark, d, "conversations")
    return P.sequence_violations(c, "conv_id", "role", "turn", opening=("system",), ending=("assistant",), before=((("user",), ("assistant",)),))


def coverage_gaps(spark, d):
    part = _t(spark, d, "part")
    labels = part.select(F.col("p_size").cast("string").alias("label"), F.col("p_size").cast("string").alias("role")).distinct()
    return P.coverage_gaps(part.select("p_brand", F.col("p_size").cast("string").alias("role")), labels, "p_brand").select("p_brand", "label")


def _units(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", (6 - F.substring("o_orderpriority", 1, 1).cast("long")).alias("importance"), F.floor("o_totalprice").cast("long").alias("seconds"))
    o = o.withColumn("role_group", F.when(F.col("importance") >= 3, F.col("importance")))
    return P.required_units(o, "o_custkey", "role_group", "importance", "o_orderkey")


def budget_selection(spark, d):
    return P.select_within_budget(_units(spark, d), "o_custkey", "o_orderkey", "importance", "o_orderkey", "seconds", F.floor(F.col("total") * 3 / 4).cast("long"))


def narrative_minimum(spark, d):
    return P.narrative_minimum(_units(spark, d), "o_custkey", "seconds", F.lit(600000).cast("long"))


def grounded_answers(spark, d):
    """Every customer with its orders; a customer without any has insufficient evidence."""
    o = _t(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    c = _t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.when(F.col("ids").isNull(), "insufficient_evidence").otherwise("grounded").alias("status"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("evidence"))


def _boxes(spark, d):
    li = _t(spark, d, "lineitem")
    q, n, p = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_partkey")
    b = li.select("l_orderkey", p.alias("id"), q.alias("q"), n.alias("n"), (n * 100 - 150).alias("x"), (q % 10 * 60).alias("y"), (200 + p % 90).alias("cx"), (100 + q).alias("cy"), (6 + q % 12).alias("font"))
    return b.withColumn("i", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("id", "n", "q", "font")))


def box_overlap(spark, d):
    """The first pair of boxes of an order that share over 65 percent of the smaller one."""
    b = _boxes(spark, d)
    a, c = (b.select("l_orderkey", *[F.col(k).alias(f"{s}{k}") for k in ("i", "x", "y", "cx", "cy")]) for s in "ab")
    hits = a.join(c, "l_orderkey").where("ai < bi").where(~((F.col("ay") > 453) & (F.col("by") > 453))).where(G.intersection_ratio("a", "b") > 0.65)
    return hits.groupBy("l_orderkey").agg(F.min(F.struct("ai", "bi")).alias("m")).select("l_orderkey", F.col("m.ai").alias("left_box"), F.col("m.bi").alias("right_box"))


def box_problems(spark, d):
    """The first box of an order with a problem, and which it is: out of bounds before small font."""
    out = (F.col("x") < 0) | (F.col("x") + F.col("cx") > 960) | (F.col("y") + F.col("cy") > 640)
    b = _boxes(spark, d).withColumn("code", F.when(out, "OUT_OF_BOUNDS_TEXT").when(F.col("font") < 8, "UNREADABLY_SMALL_FONT"))
    return R.first_hit(b, "l_orderkey", "i", F.col("code").isNotNull()).select("l_orderkey", "i", "code")


def _issues(spark, d):
    return _t(spark, d, "labels").join(_t(spark, d, "documents"), "doc_id").select("doc_id", "source", F.col("lang").alias("category"), F.when(F.col("toxic") == 1, "error").when(F.col("quality") == 0, "warning").otherwise("info").alias("severity"))


def issue_rollup(spark, d):
    return _issues(spark, d).groupBy("source").agg(V.status_of().alias("status"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in ("error", "warning", "info")])


def status_by_category(spark, d):
    found = _issues(spark, d).where("severity <> 'info'")
    return V.category_status(found, _t(spark, d, "documents").select(F.col("lang").alias("category")).distinct())


def issue_dedup(spark, d):
    """Findings of one source and severity collapse to one: the last one's values at the first one's place."""
    i = _issues(spark, d).withColumn("key", F.concat_ws("|", "source", "severity"))
    return R.choose_latest(i, "key", "doc_id").select("key", "doc_id", "position")


def verdict_to_issue(spark, d):
    code = F.when((F.col("quality") == 0) & (F.col("toxic") == 1), F.lit("CLAIM_EVIDENCE_UNSUPPORTED")).when(F.col("quality") == 0, "CLAIM_EVIDENCE_PARTIAL").when(F.col("toxic") == 1, "CLAIM_STRENGTH_OVERSTATED")
    return _t(spark, d, "labels").select("doc_id", code.alias("code")).where("code IS NOT NULL").withColumn("severity", F.when(F.col("code") == "CLAIM_EVIDENCE_PARTIAL", "warning").otherwise("error"))


def dependency_order(spark, d):
    """Purchases of users whose first signup comes later or not at all."""
    e = _t(spark, d, "events")
    first = e.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("first"))
    p = e.where("event_type = 'purchase'").join(first, "user_id", "left")
    return p.where("first IS NULL OR first >= ts").select("event_id", "user_id", F.when(F.col("first").isNull(), "STORYLINE_PREREQUISITE_MISSING").otherwise("STORYLINE_DEPENDENCY_ORDER").alias("code"))


def mutation_recall(spark, d):
    """Faults put into copies of conversations, and whether the rules find them: a missing turn, and a turn said twice."""
    c = _t(spark, d, "conversations").select("conv_id", "turn", "role")
    some = c.select("conv_id").distinct()
    case = some.select("conv_id", F.explode(F.array(F.lit("gap"), F.lit("repeat"))).alias("fault"))
    m = case.join(c, "conv_id").where("NOT (fault = 'gap' AND turn = 1)").select("conv_id", "fault", F.explode(F.when((F.col("fault") == "repeat") & (F.col("turn") == 0), F.array("turn", "turn")).otherwise(F.array("turn"))).alias("turn"))
    m = m.withColumn("case_id", F.concat_ws("-", "conv_id", "fault"))
    found = R.order_violations(m, "case_id", "turn", 0).select("case_id", F.lit("ORDER").alias("code")).unionByName(R.duplicate_keys(m, "case_id", "turn").select("case_id", F.lit("DUPLICATE").alias("code")))
    cases = case.select(F.concat_ws("-", "conv_id", "fault").alias("case_id"), F.when(F.col("fault") == "gap", "ORDER").otherwise("DUPLICATE").alias("expected"))
    return V.recall(cases, found).select("case_id", "expected", F.coalesce("detected", F.lit(False)).alias("detected"), "unexpected")


def first_hit_per_group(spark, d):
    x = _t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return R.first_hit(x, "doc_id", "line_no", F.length("line") > 200).select("doc_id", "line_no", F.length("line").alias("n_chars"))


def fingerprint_reuse(spark, d):
    x = _t(spark, d, "documents")
    new = x.select("doc_id", F.sha2("text", 256).alias("sha"))
    old = x.where("n_chars > 100").select("doc_id", F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha"))
    return R.changed(old, new, "doc_id", "sha")


def ordered_distinct_labels(spark, d):
    li = _t(spark, d, "lineitem").withColumn("label", F.concat("l_returnflag", "l_linestatus"))
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "label")))
    return li.groupBy("l_orderkey").agg(F.array_join(F.array_distinct(F.transform(rows, lambda x: x["label"])), "; ").alias("labels"))


def text_views(spark, d):
    c = _t(spark, d, "conversations")
    return V.joined_text(c, "conv_id", "turn", F.concat("role", F.lit(": "), F.length("text").cast("string")))


def merged_records(spark, d):
    """Customers over suppliers by key: preferred values where there are any."""
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("name"), F.col("c_nationkey").alias("nation"))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return R.merge_by_key(c, s, "k")


def compatibility_violations(spark, d):
    """Parts whose (type, brand digit) is not in the matrix of allowed pairs."""
    part = _t(spark, d, "part").withColumn("treatment", F.regexp_extract("p_brand", r"(\d)$", 1))
    allowed = part.where("p_size = 50").select(F.col("p_type").alias("kind"), F.col("treatment").alias("allowed"))
    return R.dangling(part.select("p_partkey", "p_type", "treatment"), allowed, ("p_type", "kind"), ("treatment", "allowed")).select("p_partkey", "p_type", "treatment")


def reused_sources(spark, d):
    """Parts that an order uses more than once other than as background (flag N)."""
    li = _t(spark, d, "lineitem")
    return li.groupBy("l_orderkey", "l_partkey").agg(F.count_if(F.col("l_returnflag") != "N").alias("uses")).where("uses > 1")


def slide_subset(spark, d):
    """Wanted numbers, those of all parts, against the orders there are: chosen ones with their status, unknown ones marked."""
    want = _t(spark, d, "part").select(F.col("p_partkey").alias("o_orderkey"))
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return want.join(o, "o_orderkey", "left").select("o_orderkey", F.coalesce("o_orderstatus", F.lit("unknown")).alias("status"))


def table_excerpt(spark, d):
    """Orders of over 8 lines show the first 2, an ellipsis, and the last 4."""
    li = _t(spark, d, "lineitem")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x["l_partkey"].cast("string"))
    g = li.groupBy("l_orderkey").agg(rows.alias("r"))
    short = F.concat(F.slice("r", 1, 2), F.array(F.lit("…")), F.slice("r", -4, 4))
    return g.select("l_orderkey", F.array_join(F.when(F.size("r") > 8, short).otherwise(F.col("r")), "|").alias("cells"))


def minutes_to_seconds(spark, d):
    return _t(spark, d, "events").select("event_id", F.bround(F.round(F.col("value") * 100) * 60 / 100 / 8).cast("long").alias("seconds"))


def picture_fit(spark, d):
    p = _t(spark, d, "part").where("p_size > 0")
    f = G.contain_fit(F.lit(1.0), F.lit(2.0), F.lit(7.0), F.lit(4.0), F.col("p_size").cast("double"), (F.col("p_partkey") % 17 + 1).cast("double"))
    return p.select("p_partkey", f.alias("f")).select("p_partkey", *[F.round(f"f.{k}", 6).alias(k) for k in ("x", "y", "w", "h")])


def field_drift(spark, d):
    """Turns whose later copy differs in role, or in the set or the order of its words."""
    c = _t(spark, d, "conversations").withColumn("words", F.split("text", " "))
    later = c.select("conv_id", "turn", F.when(F.col("turn") % 3 == 1, "user").otherwise(F.col("role")).alias("role2"), F.when(F.col("conv_id") % 4 == 0, F.reverse("words")).otherwise(F.col("words")).alias("words2"))
    j = c.join(later, ["conv_id", "turn"])
    return j.select("conv_id", "turn", (F.col("role") != F.col("role2")).alias("role_drift"), (F.array_sort(F.array_distinct("words")) != F.array_sort(F.array_distinct("words2"))).alias("set_drift"), (F.col("words") != F.col("words2")).alias("order_drift"))


def key_agreement(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"))
    return R.disagreeing(o, _t(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("paper_id")))


def events_per_window(spark, d):
    """Five-minute windows of events: the batch form of the streaming query."""
    from ..streaming.ingest import windowed_counts

    return windowed_counts(_t(spark, d, "events")).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


_UNITS = """u AS (SELECT o_custkey, o_orderkey, 6 - CAST(left(o_orderpriority, 1) AS BIGINT) AS importance, CAST(floor(o_totalprice) AS BIGINT) AS seconds, CASE WHEN 6 - CAST(left(o_orderpriority, 1) AS BIGINT) >= 3 THEN 6 - CAST(left(o_orderpriority, 1) AS BIGINT) END AS g FROM orders),
r AS (SELECT *, CASE WHEN bool_or(g IS NOT NULL) OVER (PARTITION BY o_custkey) THEN g IS NOT NULL AND row_number() OVER (PARTITION BY o_custkey, g ORDER BY importance DESC, o_orderkey) = 1
  ELSE row_number() OVER (PARTITION BY o_custkey ORDER BY importance DESC, o_orderkey) = 1 END AS required FROM u)"""
_BOXES = """b AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY id, n, q, font) AS i FROM (SELECT l_orderkey, l_partkey AS id, CAST(l_quantity AS BIGINT) AS q, l_linenumber AS n, l_linenumber * 100 - 150 AS x,
  CAST(l_quantity AS BIGINT) % 10 * 60 AS y, 200 + l_partkey % 90 AS cx, 100 + CAST(l_quantity AS BIGINT) AS cy, 6 + CAST(l_quantity AS BIGINT) % 12 AS font FROM lineitem))"""
_ISSUES = "i AS (SELECT doc_id, source, lang AS category, CASE WHEN toxic = 1 THEN 'error' WHEN quality = 0 THEN 'warning' ELSE 'info' END AS severity FROM labels JOIN documents USING (doc_id))"
_STATUS = "CASE WHEN bool_or(severity = 'error') THEN 'fail' WHEN bool_or(severity = 'warning') THEN 'pass_with_warnings' ELSE 'pass' END AS status"
QUERIES = {f.__name__: f for f in (catalog_union, dangling_refs, duplicate_keys, order_contiguity, section_parents, sequence_rules, coverage_gaps, budget_selection, narrative_minimum, grounded_answers, box_overlap, box_problems, issue_rollup, status_by_category, issue_dedup, verdict_to_issue, dependency_order, mutation_recall, first_hit_per_group, fingerprint_reuse, ordered_distinct_labels, text_views, merged_records, compatibility_violations, reused_sources, slide_subset, table_excerpt, minutes_to_seconds, picture_fit, field_drift, key_agreement, events_per_window)}
ORACLES = {
    "catalog_union": "SELECT 'd' || doc_id AS source_id, 'document' AS kind, CAST(length(text) AS INTEGER) AS n_chars FROM documents UNION ALL SELECT 'p' || page_id, 'page', length(html) FROM pages UNION ALL SELECT 'b' || item_id, 'passage', length(text) FROM benchmark UNION ALL SELECT 'c' || conv_id || '_' || turn, 'turn', length(text) FROM conversations",
    "dangling_refs": "SELECT 'order' AS kind, o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'document', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "order_contiguity": "SELECT l_orderkey, l_linenumber, CAST(e AS INTEGER) AS expected FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS e FROM lineitem) WHERE l_linenumber <> e",
    "section_parents": """WITH x AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 4 + 1 AS level FROM events),
a AS (SELECT x.event_id, x.level, max(y.event_id) AS above FROM x LEFT JOIN x AS y ON x.user_id = y.user_id AND y.event_id < x.event_id AND y.level < x.level GROUP BY ALL)
SELECT a.event_id, a.level, CASE WHEN y.level = a.level - 1 THEN above END AS parent FROM a LEFT JOIN x AS y ON y.event_id = above""",
    "sequence_rules": """WITH g AS (SELECT conv_id, min(turn) AS lo, min(turn) FILTER (role = 'system') AS s, min(turn) FILTER (role = 'user') AS u, min(turn) FILTER (role = 'assistant') AS a, max(turn) FILTER (role <> 'assistant') AS hi FROM conversations GROUP BY conv_id)
SELECT conv_id, 'opening_first' AS rule FROM g WHERE s > lo UNION ALL SELECT conv_id, 'ending_last' FROM g WHERE hi > a UNION ALL SELECT conv_id, 'order_1' FROM g WHERE a < u""",
    "coverage_gaps": "SELECT p_brand, CAST(p_size AS VARCHAR) AS label FROM (SELECT DISTINCT p_brand FROM part), (SELECT DISTINCT p_size FROM part) EXCEPT SELECT p_brand, CAST(p_size AS VARCHAR) FROM part",
    "budget_selection": f"""WITH {_UNITS},
t AS (SELECT o_custkey, CAST(sum(seconds) AS BIGINT) AS total, CAST(floor(sum(seconds) * 3 / 4) AS BIGINT) AS budget, CAST(coalesce(sum(seconds) FILTER (required), 0) AS BIGINT) AS base,
 list({{'id': o_orderkey, 's': seconds}} ORDER BY importance DESC, o_orderkey) FILTER (NOT required) AS rest, list(o_orderkey) FILTER (required) AS must FROM r GROUP BY o_custkey),
f AS (SELECT o_custkey, base, total, budget, list_reduce(list_prepend({{'t': base, 'got': must}}, list_transform(coalesce(rest, []), lambda x: {{'t': x.s, 'got': [x.id]}})),
  lambda a, x: CASE WHEN total <= budget OR a.t + x.t <= budget THEN {{'t': a.t + x.t, 'got': list_concat(a.got, x.got)}} ELSE a END) AS z FROM t WHERE base <= budget OR total <= budget),
k AS (SELECT o_custkey, unnest(z.got) AS o_orderkey FROM f)
SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS new_order FROM k""",
    "narrative_minimum": f"WITH {_UNITS} SELECT o_custkey, CAST(sum(seconds) AS BIGINT) AS minimum, CAST(600000 AS BIGINT) AS budget FROM r WHERE required GROUP BY o_custkey HAVING sum(seconds) > 600000",
    "grounded_answers": "SELECT c_custkey, CASE WHEN count(o_orderkey) = 0 THEN 'insufficient_evidence' ELSE 'grounded' END AS status, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS evidence FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "box_overlap": f"""WITH {_BOXES}, h AS (SELECT a.l_orderkey, a.i AS l, c.i AS r FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND a.i < c.i WHERE NOT (a.y > 453 AND c.y > 453)
 AND least(a.x + a.cx, c.x + c.cx) > greatest(a.x, c.x) AND least(a.y + a.cy, c.y + c.cy) > greatest(a.y, c.y)
 AND (least(a.x + a.cx, c.x + c.cx) - greatest(a.x, c.x)) * (least(a.y + a.cy, c.y + c.cy) - greatest(a.y, c.y)) / CAST(least(a.cx * a.cy, c.cx * c.cy) AS DOUBLE) > 0.65)
SELECT l_orderkey, CAST(l AS INTEGER) AS left_box, CAST(r AS INTEGER) AS right_box FROM h QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l, r) = 1""",
    "box_problems": f"""WITH {_BOXES}, c AS (SELECT *, CASE WHEN x < 0 OR x + cx > 960 OR y + cy > 640 THEN 'OUT_OF_BOUNDS_TEXT' WHEN font < 8 THEN 'UNREADABLY_SMALL_FONT' END AS code FROM b)
SELECT l_orderkey, CAST(i AS INTEGER) AS i, code FROM c WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY i) = 1""",
    "issue_rollup": f"WITH {_ISSUES} SELECT source, {_STATUS}, count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info FROM i GROUP BY source",
    "status_by_category": f"WITH {_ISSUES}, c AS (SELECT DISTINCT lang AS category FROM documents) SELECT category, {_STATUS}, count(severity) AS n_issues FROM c LEFT JOIN (SELECT * FROM i WHERE severity <> 'info') USING (category) GROUP BY category",
    "issue_dedup": f"WITH {_ISSUES} SELECT source || '|' || severity AS key, max(doc_id) AS doc_id, min(doc_id) AS position FROM i GROUP BY source, severity",
    "verdict_to_issue": "SELECT * FROM (SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 'CLAIM_EVIDENCE_UNSUPPORTED' WHEN quality = 0 THEN 'CLAIM_EVIDENCE_PARTIAL' WHEN toxic = 1 THEN 'CLAIM_STRENGTH_OVERSTATED' END AS code, CASE WHEN quality = 0 AND toxic = 0 THEN 'warning' ELSE 'error' END AS severity FROM labels) WHERE code IS NOT NULL",
    "dependency_order": "WITH f AS (SELECT user_id, min(ts) AS first FROM events WHERE event_type = 'signup' GROUP BY user_id) SELECT event_id, user_id, CASE WHEN first IS NULL THEN 'STORYLINE_PREREQUISITE_MISSING' ELSE 'STORYLINE_DEPENDENCY_ORDER' END AS code FROM events LEFT JOIN f USING (user_id) WHERE event_type = 'purchase' AND (first IS NULL OR first >= ts)",
    "mutation_recall": """WITH n AS (SELECT conv_id, max(turn) AS hi FROM conversations GROUP BY conv_id)
SELECT conv_id || '-gap' AS case_id, 'ORDER' AS expected, hi > 1 AS detected, CAST(0 AS INTEGER) AS unexpected FROM n
UNION ALL SELECT conv_id || '-repeat', 'DUPLICATE', true, 1 FROM n""",
    "first_hit_per_group": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(length(line) AS INTEGER) AS n_chars FROM l WHERE length(line) > 200 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line_no) = 1",
    "fingerprint_reuse": "SELECT doc_id, n_chars > 100 AND lang <> 'de' AS reuse FROM documents",
    "ordered_distinct_labels": """WITH f AS (SELECT l_orderkey, l_returnflag || l_linestatus AS label, min({'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey, 'd': l_quantity, 'e': l_returnflag || l_linestatus}) AS pos FROM lineitem GROUP BY ALL) SELECT l_orderkey, string_agg(label, '; ' ORDER BY pos) AS labels FROM f GROUP BY l_orderkey""",
    "text_views": "SELECT conv_id, string_agg(role || ': ' || length(text), chr(10) ORDER BY turn) AS view FROM conversations GROUP BY conv_id",
    "merged_records": "SELECT coalesce(c_custkey, s_suppkey) AS k, coalesce(CASE WHEN c_acctbal > 0 THEN c_name END, s_name) AS name, coalesce(c_nationkey, s_nationkey) AS nation FROM customer FULL JOIN supplier ON c_custkey = s_suppkey",
    "compatibility_violations": "WITH p AS (SELECT *, right(p_brand, 1) AS treatment FROM part) SELECT p_partkey, p_type, treatment FROM p WHERE (p_type, treatment) NOT IN (SELECT (p_type, treatment) FROM p WHERE p_size = 50)",
    "reused_sources": "SELECT l_orderkey, l_partkey, count(*) FILTER (l_returnflag <> 'N') AS uses FROM lineitem GROUP BY ALL HAVING uses > 1",
    "slide_subset": "SELECT p_partkey AS o_orderkey, coalesce(o_orderstatus, 'unknown') AS status FROM part LEFT JOIN orders ON o_orderkey = p_partkey",
    "table_excerpt": "WITH g AS (SELECT l_orderkey, list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey, l_suppkey) AS r FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, array_to_string(CASE WHEN len(r) > 8 THEN list_concat(r[1:2], ['…'], r[-4:]) ELSE r END, '|') AS cells FROM g",
    "minutes_to_seconds": "SELECT event_id, CAST(round_even(round(value * 100) * 60 / 100 / 8, 0) AS BIGINT) AS seconds FROM events",
    "picture_fit": "WITH s AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS iw, CAST(p_partkey % 17 + 1 AS DOUBLE) AS ih, least(7.0::DOUBLE / p_size, 4.0::DOUBLE / (p_partkey % 17 + 1)) AS k FROM part WHERE p_size > 0) SELECT p_partkey, round(1 + (7 - iw * k) / 2, 6) AS x, round(2 + (4 - ih * k) / 2, 6) AS y, round(iw * k, 6) AS w, round(ih * k, 6) AS h FROM s",
    "field_drift": """WITH c AS (SELECT *, string_split(text, ' ') AS words FROM conversations)
SELECT conv_id, turn, turn % 3 = 1 AND role <> 'user' AS role_drift, false AS set_drift, conv_id % 4 = 0 AND words <> list_reverse(words) AS order_drift FROM c""",
    "key_agreement": "SELECT count(DISTINCT k) AS n FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT r_regionkey FROM region) HAVING count(DISTINCT k) > 1",
    "events_per_window": "SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
}
