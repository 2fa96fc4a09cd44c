"""Operator 6: quality rules with risk-controlled cutoffs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SYMBOLS = "#*$%&|<>"
#: Share of good documents that the learned rules may reject in a stratum, over all rules together.
MAX_FALSE_REJECTION = 0.05
#: Chance that any stratum's share is larger than that.
DELTA = 0.05
#: Candidate cutoffs of every rule, in thousandths; a document fails a rule if its measure is above the cutoff.
CUTOFFS = (5, 10, 20, 30, 50, 75, 100, 150, 200, 250, 300, 400, 500, 600, 700, 800, 900)
#: Measures in thousandths: symbols and capitals per character of words, repeated per line and per word.
MEASURES = ("m_symbols", "m_capitals", "m_lines", "m_repeats")


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, also where body uses it within a lambda."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column, window: int = 3) -> Column:
    """Number of words that lie in a window of `window` words found twice or more, the first included.

    Sorted 64-bit values hold 42 bits of a window's hash over 22 bits of its position, so equal hashes stand side by side. The few
    candidates are then compared as text, and the covered positions are the sum of min(window, distance to the next).
    Texts of over 4 million words take the candidates of all positions: slower, the same result.
    """

    def with_neighbour(xs: Column, same) -> Column:
        after = lambda v: F.filter(v, lambda x, j: same(x, F.get(v, j + 1)))  # noqa: E731  most texts have none: one comparison each
        either = lambda v: F.filter(v, lambda x, j: same(x, F.get(v, j + 1)) | same(x, F.get(v, j - 1)))
        return let(xs, lambda v: let(after(v), lambda f: F.when(F.size(f) > 0, either(v)).otherwise(f)))

    def candidates(w: Column) -> Column:
        packed = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.shiftleft(F.xxhash64(*[F.get(w, i + k) for k in range(window)]), 22).bitwiseOR(i.cast("long")))
        near = with_neighbour(F.sort_array(packed), lambda a, b: F.shiftright(a, 22) == F.shiftright(b, 22))
        return F.when(F.size(w) < (1 << 22), F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << 22) - 1)).cast("int"))).otherwise(F.sequence(F.lit(0), F.size(w) - window))

    def again(w: Column) -> Column:
        grams = F.sort_array(F.transform(candidates(w), lambda i: F.struct(F.array_join(F.slice(w, i + 1, window), " ").alias("gram"), i.alias("i"))))
        return F.sort_array(F.transform(with_neighbour(grams, lambda a, b: a["gram"] == b["gram"]), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.when(F.size(at) > 0, window + F.aggregate(at, F.struct(F.lit(0).alias("n"), F.get(at, 0).alias("last")), lambda s, i: F.struct((s["n"] + F.least(F.lit(window), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"])).otherwise(0)

    return F.when(F.size(words) >= window, let(words, lambda w: let(again(w), covered))).otherwise(0).cast("long")


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """One row per document: id, stratum, the base counts and the measures in thousandths. Null text: no words, all 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.col(text_col).alias("text"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select("doc_id", "stratum", text.alias("text"), F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"), lines.alias("lines"))
    d = d.select("doc_id", "stratum", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.regexp_count("text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), repeated_words(F.col("words")).alias("n_repeat_words"), F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"))
    per = lambda a, b: F.coalesce(F.expr(f"{a} * 1000 div nullif({b}, 0)"), F.lit(0)).cast("long")
    return d.select("*", per("n_symbols", "word_chars").alias("m_symbols"), per("n_capitals", "word_chars").alias("m_capitals"), per("n_dup_lines", "n_lines").alias("m_lines"), per("n_repeat_words", "n_words").alias("m_repeats"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series ten steps up, where it is exact to double precision."""
    y = x + 10
    steps = F.log(x)
    for k in range(1, 10):
        steps = steps + F.log(x + k)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5)) - steps


def binomial_cdf(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), exact to double precision where k < n p; 1 from there on (no bound below p is wanted there).

    The largest term comes from log-gamma; the others fall at least geometrically below it and are added until they
    cannot matter: 12 standard deviations and 50 terms.
    """
    n, k = n.cast("double"), k.cast("double")
    top = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    terms = F.sequence(F.lit(0), F.least(k, F.ceil(50 + 12 * F.sqrt(n * p)).cast("double")).cast("int"))
    total = F.aggregate(terms, F.struct(F.lit(1.0).alias("t"), F.lit(0.0).alias("s")), lambda a, j: F.struct((a["t"] * (k - j) * (1 - p) / ((n - k + j + 1) * p)).alias("t"), (a["s"] + a["t"]).alias("s")), lambda a: a["s"])
    return F.when(k < n * p, F.least(F.lit(1.0), top * total)).otherwise(1.0)


def learn_cutoffs(measures: DataFrame, labels: DataFrame, max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(stratum, measure, cutoff): the lowest cutoff of each rule that is proven to reject few good documents of the stratum.

    Good documents are the labelled ones with quality 1; the cutoffs are fixed beforehand, so all of them serve as holdout. A cutoff
    is proven if P(Binomial(good, limit / rules) <= good rejected) <= delta / (strata * rules): by the union over the
    rules each stratum's share stays within the limit, and over all strata together this fails with a chance of delta at most.
    Within a rule, cutoffs are tried from the mildest on until one fails (fixed-sequence testing), which needs no
    further correction. A stratum with too few labels for any proof keeps everything.
    Counting is one aggregation with map-side combine: a row per stratum, whatever the size of the strata.
    """
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    above = [F.sum((F.col(m) > c).cast("long")).alias(f"{m}_{c}") for m in MEASURES for c in cutoffs]
    counts = measures.where(~base_failed()).join(good, "doc_id").groupBy("stratum").agg(F.count("*").alias("n"), *above)
    counts = stored(counts, "quality-counts")
    strata = counts.count()  # of those with a good document, counted before each becomes a row per cutoff
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.lit(c).alias("cutoff"), F.col(f"{m}_{c}").alias("k")) for m in MEASURES for c in cutoffs]))
    counts = counts.select("stratum", "n", each.alias("c")).select("stratum", "n", "c.*")
    tested = counts.withColumn("proven", binomial_cdf(F.col("n"), F.col("k"), max_false_rejection / len(MEASURES)) <= delta / (max(1, strata) * len(MEASURES)))
    order = Window.partitionBy("stratum", "measure").orderBy(F.desc("cutoff"))
    return tested.withColumn("so_far", F.min("proven").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("so_far").groupBy("stratum", "measure").agg(F.min("cutoff").alias("cutoff"))


def judge_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Base counts, base_failed, the rules that a document fails, and kept.

    Measures are stored once and serve both the learning and the verdicts. Cutoffs are a row per stratum; Spark broadcasts
    them where it measures them as small.
    Nulls: a null text has no words and fails the base rule; a null stratum is one of its own; null labels count
    as not good; an id that is labelled twice counts by its lower label. Repeated rows are judged each. Without
    labels only the base rule rejects. Extra columns are ignored, whatever their names. A measure that equals its cutoff passes. A very long text is
    measured whole, as the row it is. An empty table gives no rows.
    """
    m = stored(text_measures(docs, id_col, text_col, stratum_col), "quality-measures")
    cuts = learn_cutoffs(m, labels).groupBy("stratum").agg(*[F.max(F.when(F.col("measure") == x, F.col("cutoff"))).alias(f"c{x}") for x in MEASURES])
    cuts = stored(cuts, "quality-cutoffs")
    failed = F.array_compact(F.array(F.when(base_failed(), F.lit("base")), *[F.when(F.col(x) > F.col(f"c{x}"), F.lit(x)) for x in MEASURES]))
    return m.join(cuts, "stratum", "left").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (F.size(failed) == 0).alias("kept"), F.array_join(failed, ",").alias("failed_rules"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_CUTS = ", ".join(map(str, CUTOFFS))
OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT n, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT n, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT n, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT n, i FROM g QUALIFY count(*) OVER (PARTITION BY n, gram) > 1),
p AS (SELECT n, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY n),
b AS (SELECT doc_id, stratum, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals
      FROM d JOIN w USING (n) LEFT JOIN p USING (n)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(n_symbols * 1000 // nullif(word_chars, 0), 0) AS m_symbols, coalesce(n_capitals * 1000 // nullif(word_chars, 0), 0) AS m_capitals,
             coalesce(n_dup_lines * 1000 // nullif(n_lines, 0), 0) AS m_lines, coalesce(n_repeat_words * 1000 // nullif(n_words, 0), 0) AS m_repeats FROM b),
q AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
u AS (SELECT stratum, unnest([{{'m': 's', 'v': m_symbols}}, {{'m': 'c', 'v': m_capitals}}, {{'m': 'l', 'v': m_lines}}, {{'m': 'r', 'v': m_repeats}}]) AS x FROM m JOIN q USING (doc_id) WHERE NOT base_failed),
k AS (SELECT stratum, x.m AS m, cutoff, count(*) AS n, count(*) FILTER (x.v > cutoff) AS k FROM u, (SELECT unnest([{_CUTS}]) AS cutoff) GROUP BY ALL),
t AS (SELECT stratum, m, cutoff, k < n * {MAX_FALSE_REJECTION / 4} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({MAX_FALSE_REJECTION / 4}) + (n - i) * ln({1 - MAX_FALSE_REJECTION / 4}))))
             <= {DELTA} / (4 * (SELECT count(DISTINCT stratum) FROM k)) AS proven FROM k),
c AS (SELECT stratum, m, min(cutoff) AS c FROM (SELECT *, bool_and(proven) OVER (PARTITION BY stratum, m ORDER BY cutoff DESC) AS ok FROM t) WHERE ok GROUP BY ALL),
v AS (SELECT stratum, max(c) FILTER (m = 's') AS s, max(c) FILTER (m = 'c') AS cc, max(c) FILTER (m = 'l') AS l, max(c) FILTER (m = 'r') AS r FROM c GROUP BY stratum),
f AS (SELECT m.*, list_filter([CASE WHEN base_failed THEN 'base' END, CASE WHEN m_symbols > s THEN 'm_symbols' END, CASE WHEN m_capitals > cc THEN 'm_capitals' END, CASE WHEN m_lines > l THEN 'm_lines' END, CASE WHEN m_repeats > r THEN 'm_repeats' END], lambda x: x IS NOT NULL) AS fs
      FROM m LEFT JOIN v USING (stratum))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, len(fs) = 0 AS kept, array_to_string(fs, ',') AS failed_rules FROM f
"""
