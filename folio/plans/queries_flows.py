"""Queries over what happens to builds: their states from events, and which steps can be re-used when inputs change."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import tables
from ..operators import benchmark, qa, reuse
from ..streaming import builds
from . import flows
from .queries_decks import _X, _lines, _t, _text

PATIENCE = timedelta(hours=18)
#: Lines of a task of `deck_factual`. A line is a few bytes of a shuffle and then some eight rows of a deck, so partitions are not left to its size in bytes.
LINES_A_TASK = 100_000


def build_states(spark, d):
    """Users as builds, their events as what happens to them."""
    i, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "error", F.when(i % 3 == 0, "failed").otherwise("started")).when(t == "signup", F.when(i % 4 == 0, "submitted").otherwise("completed")).when(t == "click", "started").when(t == "view", "completed").when(i % 6 == 0, "files_lost").when(i % 6 == 1, "paused").otherwise("started")
    e = _t(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("at"), i.alias("seq"), kind.alias("event"), F.when(i % 9 == 0, i % 8).cast("int").alias("step"), F.when(i % 40 == 4, "g").otherwise("f").alias("fingerprint"))
    s = builds.build_states(e, PATIENCE)
    return s.select(F.col("run_id").alias("user_id"), "fingerprint", "done", "phase", "rejected", "abandoned", F.col("at").cast("timestamp_ntz").alias("last_event"), "step", "status")


def reuse_chain(spark, d):
    """Orders as builds whose sources, budgets, themes and providers may have changed since the last one: which steps are computed again."""
    k = F.col("o_orderkey")
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber", "l_partkey")
    given = _t(spark, d, "orders").select(k.alias("run_id"), F.col("o_totalprice").cast("string").alias("price"), F.lit(True).alias("options")).unionByName(lines, allowMissingColumns=True).repartition("run_id")
    r, number = F.col("run_id"), F.col("l_linenumber")  # both builds read the rows as they lie then

    def own(changed: bool):
        new = lambda every: (F.when(r % every == 0, F.lit("new")) if changed else F.lit(None).cast("string"))
        part = lambda step, name, digest: F.struct(F.lit(step).alias("step"), (F.lit(name) if isinstance(name, str) else name).alias("part"), digest.alias("digest"))
        options = F.array(part("understand", "provider", F.lit("p")), part("plan", "budget", F.coalesce(new(5), "price")), part("spec", "theme", F.coalesce(new(7), F.lit("plain"))), part("render", "theme", F.coalesce(new(7), F.lit("plain"))), part("semantic", "provider", new(13)), part("qa", "version", F.coalesce(new(17), F.lit("1"))))
        source = F.array(part("parse", _text("line", number), F.coalesce(F.when(number == 1, new(11)), F.md5(_text(F.col("l_partkey"))))))
        return reuse.chain_digests(given.select(r, F.inline(F.when(F.col("options"), options).otherwise(source))))

    last = own(False).where(r % 19 != 0)  # some were never built
    return reuse.reuse_plan(own(True), last).select(r.alias("o_orderkey"), "step", "action")


def deck_factual(spark, d):
    """Findings on evidence, citations, numbers and visuals of the decks that orders are; each slide has its own line and the one before as evidence."""
    tasks = _t(spark, d, "lineitem").count() // LINES_A_TASK + 1
    x, p, s, q, n = _lines(spark, d, tasks), *(F.col(c) for c in ("p", "s", "q", "order"))
    own, before = _text("e", n), F.when(n > 1, _text("e", n - 1))
    ids = F.array_compact(F.array(own, before, F.when(p % 29 == 0, _text("x", n))))
    slides = x.select("paper_id", "slide_id", n, F.lit("t").alias("title"), _text("claim ", p).alias("main_claim"), F.array(F.lit("b")).alias("body"), F.lit("k").alias("takeaway"), ids.alias("evidence_ids"))
    nodes = x.select("paper_id", own.alias("id"), F.when(q % 4 == 0, "experimental_result").otherwise("method").alias("type"), F.when(p % 7 == 0, "no part").otherwise(_text("part ", p)).alias("claim"), F.when(q % 5 == 0, "low").otherwise("high").alias("confidence"), F.array(_text("src", n)).alias("source_ids"), F.array(F.lit("said")).alias("excerpts"))
    named = F.when(q % 6 == 0, F.array(F.lit("bad"))).when(q % 6 == 1, F.array().cast("array<string>")).otherwise(F.array(_text("src", n)))
    cited = F.array_compact(F.array(F.when(s % 13 != 0, F.struct(F.lit(0).alias("pos"), own.alias("evidence_id"), named.alias("source_ids"))), F.when(n > 1, F.struct(F.lit(1).alias("pos"), before.alias("evidence_id"), F.array(_text("src", n - 1)).alias("source_ids")))))
    citations = x.select("paper_id", "slide_id", F.inline(cited))
    kind = F.element_at(F.array(*map(F.lit, ("source_asset", "source_table", "source_equation", "conceptual_diagram"))), (p % 4 + 1).cast("int"))
    visuals = x.select("paper_id", "slide_id", kind.alias("kind"), _text("r", n).alias("source_ref"))
    known = x.where("s % 3 <> 0").select("paper_id", kind.alias("kind"), _text("r", n).alias("source_ref"), (s % 5 != 0).alias("intact"))
    agreeing = x.select("paper_id").distinct().select("paper_id", F.when(F.col("paper_id") % 23 == 0, 2).otherwise(1).alias("n"))
    found = qa.factual(slides, citations, visuals, nodes, known, agreeing, tasks)
    joined = [F.array_join(c, ",").alias(c) for c in ("slide_ids", "evidence_ids", "source_ids")]
    return found.select(F.col("paper_id").alias("l_orderkey"), "code", "severity", *joined, "repairability", (F.col("suggested_action") != "").alias("advised"))


def quality_of_talks(spark, d):
    """The whole check of conversations as decks: titles are repaired and checked again, then checks, findings and status of each category."""
    turn, conv, chars = F.col("turn"), F.col("conv_id"), F.col("turn") + 1
    c = _t(spark, d, "conversations").withColumn("last", turn == F.max("turn").over(Window.partitionBy("conv_id")))
    words = F.repeat(F.lit("ab"), chars.cast("int"))
    base = c.select(conv.alias("paper_id"), _text("s", turn).alias("slide_id"), _text("u", turn).alias("unit_id"), (turn + 1).alias("order"), F.lit("q").alias("question"), F.concat(F.lit("claim "), words).alias("main_claim"), F.array(F.lit("e")).alias("evidence_ids"), F.lit(20).cast("long").alias("seconds"), "last", turn)
    roles = F.array(*map(F.lit, ("problem", "core_insight", "experiments", "conclusion", "limitations")))
    units = base.select("paper_id", "unit_id", "order", "question", "main_claim", "evidence_ids", "seconds", F.element_at(roles, F.least(turn + 1, F.lit(5)).cast("int")).alias("role"))
    ending = F.when(F.col("last") & (F.col("paper_id") % 2 == 0), "结束").otherwise("next")
    slides = base.select("paper_id", "slide_id", "unit_id", "order", "question", F.when(turn % 2 == 0, "Claim of note。").otherwise("Claim of note").alias("title"), "main_claim", F.array(F.lit("b")).alias("body"), F.lit("k").alias("takeaway"), "evidence_ids", F.lit("why").alias("purpose"), F.lit("why").alias("notes_purpose"), F.col("main_claim").alias("notes_message"), F.concat(F.lit("the claim says "), words).alias("notes_script"), ending.alias("notes_transition"), F.col("seconds").alias("notes_seconds"))
    papers = c.select(conv.alias("paper_id")).distinct()
    deck = {
        "slides": slides, "units": units, "plans": papers.select("paper_id", F.lit(100).alias("budget"), F.array().cast("array<string>").alias("coverage_gaps")),
        "nodes": papers.select("paper_id", F.lit("e").alias("id"), F.lit("method").alias("type"), F.lit("c").alias("claim"), F.when(F.col("paper_id") % 3 == 0, "low").otherwise("high").alias("confidence"), F.array(F.lit("src")).alias("source_ids"), F.array(F.lit("x")).alias("excerpts")),
        "citations": slides.select("paper_id", "slide_id", F.lit("e").alias("evidence_id"), F.array(F.lit("src")).alias("source_ids"), F.lit(0).alias("pos")), "visuals": slides.where("false").select("paper_id", "slide_id", F.lit("").alias("kind"), F.lit("").alias("source_ref"), F.lit("").alias("treatment"), F.lit(0).alias("pos")),
        "known": slides.where("false").select("paper_id", F.lit("").alias("kind"), F.lit("").alias("source_ref"), F.lit(True).alias("intact")),
    }
    return flows.run_qa(deck)["categories"].select(F.col("paper_id").alias("conv_id"), "category", "status", "n_issues", "checks_run")


def mutation_benchmark(spark, d):
    """Orders as judged decks, a fault put into a copy of each, and whether the semantic rules find it."""
    x, k, at = _lines(spark, d), F.col("paper_id"), F.col("order")
    slides = x.select("paper_id", "slide_id", at)
    evaluations = x.select("paper_id", "slide_id", F.when((k % 5 == 0) & (at == 1), "partially_supported").otherwise("supported").alias("claim_evidence"), F.lit("r").alias("claim_evidence_rationale"), F.lit("calibrated").alias("claim_strength"), F.lit("r").alias("claim_strength_rationale"), F.array(F.lit("e")).alias("evidence_ids"))
    dependencies = x.where("order > 1").select("paper_id", "slide_id", F.lit(0).alias("pos"), F.lit("c").alias("concept"), F.lit("r").alias("rationale"), F.lit(True).alias("required"), F.array(_text("s", at - 1)).alias("prerequisite_slide_ids"))
    which = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % 4 + 1).cast("int"))
    cases = _t(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id")).select(
        _text("case", k).alias("case_id"), k, which("s1", "s1", "s2", "s1").alias("slide_id"), F.when(k % 8 == 7, "rewrite").otherwise(which("claim_evidence", "claim_strength", "dependency_order", "dependency_order")).alias("operation"),
        which("unsupported", "overstated", '["s2"]', '["s1"]').alias("value"), which("CLAIM_EVIDENCE_UNSUPPORTED", "CLAIM_STRENGTH_OVERSTATED", "STORYLINE_DEPENDENCY_ORDER", "STORYLINE_DEPENDENCY_ORDER").alias("expected"),
    )
    return benchmark.run(cases, slides, evaluations, dependencies)


def table_grids(spark, d):
    """Orders as LaTeX tables, their lines as rows with a nested span; some have a width, some a declaration whose braces do not match, some no end."""
    x, k = _lines(spark, d), F.col("paper_id")
    row = _text(r"\multicolumn{2}{c}{\textbf{x{", F.col("p"), r"} & y}} & s\&", F.col("s"), r" & $q^{", F.col("q"), r"}$ \\[2pt] \cmidrule(lr){1-2} ")
    rows = x.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", row.alias("row")))), lambda r: r["row"]), "\n").alias("rows"))
    begin = F.when(k % 7 == 0, r"\begin{tabular}{l{c ").when(k % 3 == 0, r"text \begin{tabular*}{\textwidth}{@{}l|p{3cm}r@{\hskip {2pt}}}").otherwise(r"\begin{tabular}{lcrX}")
    latex = F.concat(begin, F.lit("\n\\toprule a & b % & no\n \\\\ \\midrule "), "rows", F.when(k % 5 == 0, "").otherwise(r"\bottomrule \end{tabular} & after"))
    t = rows.select(k.alias("l_orderkey"), latex.alias("latex")).withColumn("table", tables.parsed(F.col("latex")))
    cells = F.array_join(F.transform(tables.grid(F.col("table")), lambda r: F.array_join(r, ";")), "|")
    return t.select("l_orderkey", tables.column_count(F.col("latex"), F.col("table")).alias("n_columns"), F.coalesce(cells, F.lit("")).alias("cells"))


QUERIES = {f.__name__: f for f in (build_states, reuse_chain, deck_factual, quality_of_talks, mutation_benchmark, table_grids)}
ORACLES = {
    "build_states": """WITH RECURSIVE e AS (SELECT user_id, ts AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CASE WHEN event_id % 9 = 0 THEN event_id % 8 END AS step, CASE WHEN event_id % 40 = 4 THEN 'g' ELSE 'f' END AS f,
 CASE event_type WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'started' END WHEN 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 'submitted' ELSE 'completed' END WHEN 'click' THEN 'started' WHEN 'view' THEN 'completed'
 ELSE CASE event_id % 6 WHEN 0 THEN 'files_lost' WHEN 1 THEN 'paused' ELSE 'started' END END AS event FROM events),
s AS (SELECT user_id, 0::BIGINT AS k, NULL::VARCHAR AS fp, 0::BIGINT AS done, 'pending' AS phase, 0 AS rejected, 0 AS abandoned, NULL::TIMESTAMP AS tm FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT user_id, k, CASE WHEN kind = 'fresh' THEN f ELSE fp END, CASE kind WHEN 'fresh' THEN 0 WHEN 'start' THEN due WHEN 'end' THEN done + 1 WHEN 'lost' THEN gone ELSE done END,
  CASE kind WHEN 'start' THEN 'running' WHEN 'fail' THEN 'failed' WHEN 'no' THEN phase ELSE 'pending' END, rejected + CASE WHEN kind = 'no' THEN 1 ELSE 0 END, abandoned, tm
 FROM (SELECT *, CASE WHEN event = 'submitted' AND f IS DISTINCT FROM fp THEN 'fresh' WHEN event = 'submitted' AND phase <> 'running' THEN 'again' WHEN event = 'started' AND fp IS NOT NULL AND phase <> 'running' AND due BETWEEN 0 AND 6 AND due <= done THEN 'start'
   WHEN event = 'completed' AND phase = 'running' AND due = done THEN 'end' WHEN event = 'failed' AND phase = 'running' AND due = done THEN 'fail' WHEN event = 'files_lost' AND phase <> 'running' AND gone >= 0 AND gone < done THEN 'lost' ELSE 'no' END AS kind
  FROM (SELECT s.user_id, e.k, s.fp, s.done, e.tm, e.event, e.f, coalesce(e.step, s.done) AS due, coalesce(e.step, s.done - 1) AS gone, s.rejected, CASE WHEN s.phase = 'running' AND e.tm - s.tm > INTERVAL 18 HOUR THEN 'failed' ELSE s.phase END AS phase,
    s.abandoned + CASE WHEN s.phase = 'running' AND e.tm - s.tm > INTERVAL 18 HOUR THEN 1 ELSE 0 END AS abandoned FROM s JOIN e ON e.user_id = s.user_id AND e.k = s.k + 1) a) b),
l AS (SELECT *, phase = 'running' AND (SELECT max(ts) FROM events) - tm > INTERVAL 18 HOUR AS late FROM s QUALIFY k = max(k) OVER (PARTITION BY user_id)),
m AS (SELECT user_id, fp AS fingerprint, CAST(done AS INTEGER) AS done, CASE WHEN late THEN 'failed' ELSE phase END AS phase, rejected, abandoned + CASE WHEN late THEN 1 ELSE 0 END AS abandoned, tm AS last_event FROM l)
SELECT *, ['parse', 'understand', 'plan', 'spec', 'render', 'qa', 'package'][done + 1] AS step, CASE WHEN fingerprint IS NULL THEN 'unknown' WHEN done = 7 THEN 'completed' ELSE phase END AS status FROM m""",
    "reuse_chain": """WITH n AS (SELECT o_orderkey AS k, o_orderkey % 19 = 0 AS never, o_orderkey % 11 = 0 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 1) AS source, o_orderkey % 5 = 0 AS budget, o_orderkey % 7 = 0 AS theme, o_orderkey % 13 = 0 AS semantic, o_orderkey % 17 = 0 AS version FROM orders),
s AS (SELECT k, unnest([struct_pack(step := 'parse', again := never OR source), struct_pack(step := 'understand', again := never OR source), struct_pack(step := 'plan', again := never OR source OR budget), struct_pack(step := 'spec', again := never OR source OR budget OR theme),
 struct_pack(step := 'render', again := never OR source OR budget OR theme), struct_pack(step := 'semantic', again := never OR source OR budget OR theme OR semantic), struct_pack(step := 'qa', again := never OR source OR budget OR theme OR semantic OR version)]) AS x FROM n)
SELECT k AS o_orderkey, x.step AS step, CASE WHEN x.again THEN 'compute' ELSE 'reuse' END AS action FROM s""",
    "deck_factual": f"""WITH {_X}, y AS (SELECT *, 's' || o AS sl, 'e' || o AS e, lag(q) OVER w AS pq FROM x WINDOW w AS (PARTITION BY l_orderkey ORDER BY o)), g AS (SELECT *, e || CASE WHEN o > 1 THEN ',e' || (o - 1) ELSE '' END AS es, ['asset', 'table', 'equation', 'diagram'][p % 4 + 1] AS kind FROM y WHERE p % 29 <> 0)
SELECT DISTINCT l_orderkey, 'PAPER_ID_MISMATCH' AS code, 'error' AS severity, '' AS slide_ids, '' AS evidence_ids, '' AS source_ids, 'none' AS repairability, true AS advised FROM x WHERE l_orderkey % 23 = 0
UNION ALL SELECT l_orderkey, 'UNKNOWN_EVIDENCE', 'error', sl, 'x' || o, '', 'none', true FROM y WHERE p % 29 = 0 UNION ALL SELECT l_orderkey, 'MISSING_CITATION', 'error', sl, e, '', 'manual', true FROM g WHERE s % 13 = 0
UNION ALL SELECT l_orderkey, 'CITATION_SOURCE_MISMATCH', 'error', sl, e, CASE WHEN q % 6 = 0 THEN 'bad' ELSE '' END, 'none', true FROM g WHERE s % 13 <> 0 AND q % 6 < 2 UNION ALL SELECT l_orderkey, 'UNSUPPORTED_NUMBER', 'error', sl, es, '', 'none', true FROM g WHERE p % 7 = 0
UNION ALL SELECT l_orderkey, 'UNKNOWN_SOURCE_' || upper(kind), 'error', sl, '', 'r' || o, 'none', true FROM g WHERE s % 3 = 0 AND kind <> 'diagram' UNION ALL SELECT l_orderkey, 'SOURCE_ASSET_HASH_MISMATCH', 'error', sl, '', 'r' || o, 'none', true FROM g WHERE s % 3 <> 0 AND s % 5 = 0 AND kind = 'asset'
UNION ALL SELECT l_orderkey, 'GENERATED_EXPERIMENT_VISUAL', 'error', sl, es, '', 'manual', true FROM g WHERE kind = 'diagram' AND (q % 4 = 0 OR pq % 4 = 0)
UNION ALL SELECT l_orderkey, 'LOW_CONFIDENCE_EVIDENCE', 'warning', sl, concat_ws(',', CASE WHEN q % 5 = 0 THEN e END, CASE WHEN pq % 5 = 0 THEN 'e' || (o - 1) END), '', 'manual', true FROM g WHERE q % 5 = 0 OR pq % 5 = 0""",
    "quality_of_talks": """WITH g AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, 'factual' AS category, CASE WHEN conv_id % 3 = 0 THEN 'pass_with_warnings' ELSE 'pass' END AS status, CASE WHEN conv_id % 3 = 0 THEN n ELSE 0 END AS n_issues, 1 + 4 * n AS checks_run FROM g
UNION ALL SELECT conv_id, 'storyline', CASE WHEN n < 4 THEN 'fail' WHEN n < 5 THEN 'pass_with_warnings' ELSE 'pass' END, greatest(0, 4 - n) + CASE WHEN n < 5 THEN 1 ELSE 0 END, 5 + n FROM g
UNION ALL SELECT conv_id, 'visual', 'pass', 0, 6 + n FROM g UNION ALL SELECT conv_id, 'presentation', CASE WHEN n > 5 THEN 'fail' ELSE 'pass' END, conv_id % 2 + CASE WHEN n > 5 THEN 1 ELSE 0 END, 3 + 5 * n FROM g""",
    "mutation_benchmark": """WITH g AS (SELECT o_orderkey AS k, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
p AS (SELECT *, CASE WHEN n = 0 THEN 'unknown paper' WHEN k % 4 = 2 AND n < 2 THEN 'unknown slide' WHEN k % 8 = 7 THEN 'unsupported operation' WHEN k % 4 = 3 THEN 'no dependency' END AS problem FROM g)
SELECT 'case' || k AS case_id, ['CLAIM_EVIDENCE_UNSUPPORTED', 'CLAIM_STRENGTH_OVERSTATED', 'STORYLINE_DEPENDENCY_ORDER', 'STORYLINE_DEPENDENCY_ORDER'][k % 4 + 1] AS expected, CASE WHEN problem IS NULL THEN true END AS detected,
CAST(CASE WHEN problem IS NULL THEN CASE WHEN k % 5 = 0 AND k % 4 <> 0 THEN 1 ELSE 0 END END AS INTEGER) AS unexpected, problem FROM p""",
    "table_grids": f"""WITH {_X} SELECT l_orderkey, CAST(CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN 3 ELSE 4 END AS INTEGER) AS n_columns,
CASE WHEN l_orderkey % 7 = 0 OR l_orderkey % 5 = 0 THEN '' ELSE 'a;b;|' || string_agg('x' || p || ' & y;s&' || s || ';q^' || q, '|' ORDER BY o) END AS cells FROM x GROUP BY l_orderkey""",
}
