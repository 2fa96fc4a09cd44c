"""Operators 3, 4 and 6 against brute force on small tables with nulls, ties, repeats and clashing names."""

import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction
from math import comb, floor

import pytest
from pyspark.sql import functions as F

from folio.llm import mixing, quality_rules, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, size long, skey string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", 5, "s") for r in rows], DOCS)


def docs(spark, extra=()):
    rows = [(i, " ".join(["w"] * (i * 7 % 40)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", None), (102, "x " * 3000, "en", None), (103, "\u00a0 a\tb\x0bc", "de", "Z"), (None, "two words", "en", "s1"), (5, "again five", "en", "s2")]
    return rows + list(extra)


def targets(sizes, weights=(5, 2, 1), most=3):
    """Resharing as the words of the contract say it: fill by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    got, open_, left = dict.fromkeys(names, Fraction(0)), set(names), Fraction(sum(sizes.values()))
    while left > 0 and open_:
        level, over = left / sum(w[s] for s in open_), set()
        for s in open_:
            if got[s] + level * w[s] > most * sizes[s]:
                over.add(s)
        if not over:
            for s in open_:
                got[s] += level * w[s]
            break
        for s in over:
            left += got[s] - most * sizes[s]
            got[s] = Fraction(most * sizes[s])
        open_ -= over
    return got


def test_mix_matches_brute_force(spark):
    rows = docs(spark)
    got = mixing.plan_mix(frame(spark, rows)).collect()
    size = lambda t: len(WORD.findall(t or ""))
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += size(t)
    want = targets(sizes)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - float(want[r["source"]])) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, n in taken.items():
        assert abs(n - floor(want[s])) <= 1, s
    # whole words of a source lie before the cut in hash order
    by = sorted((hashlib.md5(str(r["doc_id"]).encode()).hexdigest(), r["taken"] / r["size"]) for r in got if r["source"] == "s0" and r["size"])
    assert [b for _, b in by] == sorted((b for _, b in by), reverse=True)
    again = mixing.plan_mix(frame(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_meets_its_targets_with_repeated_rows(spark):
    """Many rows of one id, of null ids and of equal texts lie at the cuts: taken words are the targets, to the word."""
    rng = random.Random(3)
    rows = [(None, "n " * rng.randrange(1, 300), "en", "s1") for _ in range(52)] + [(7, "r " * rng.randrange(1, 9000), "en", "s0") for _ in range(9)]
    rows += [(8, "same words here", "en", "s2")] * 40 + [(i, "w " * rng.randrange(90), "en", f"s{i % 3}") for i in range(20, 50)]
    got = mixing.plan_mix(frame(spark, rows)).collect()
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert {s: floor(t) for s, t in target.items()} == dict(taken)


def test_running_sums(spark):
    """Prefix sums over ranges equal a plain loop, with a hot group and ties."""
    rng = random.Random(5)
    rows = [(rng.choice("aaaab"), rng.randrange(50), rng.randrange(10), i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, v long, i int")
    got = {r["i"]: r["before"] for r in mixing.running(df, ["g"], ["o", "i"], {"before": F.col("v")}, "test").collect()}
    want, sums = {}, defaultdict(int)
    for g, o, v, i in sorted(rows, key=lambda r: (r[0], r[1], r[3])):
        want[i] = sums[g]
        sums[g] += v
    assert got == want


def test_mix_documents_repeat_and_keep_columns(spark):
    d = frame(spark, docs(spark))
    m = mixing.mix(d)
    assert m.columns == d.columns
    n = {r["doc_id"]: r["n"] for r in m.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert n[100] == n[101] == 1 and max(v for k, v in n.items() if k != 5) <= 3


def test_mix_empty(spark):
    e = frame(spark, []).limit(0)
    assert mixing.plan_mix(e).count() == 0 and mixing.mix(e).count() == 0


URLS = ["http://a.net/x", "http://net/", "http://net", "https://Example.NET/en/1?x#y", "http://sub.example.net/en/", "http://example.net/en", "ftp://badexample.net/en/", "http://a.example.com/de/z", "http://example.com/fr/", "http://x.org/fr/1", "http://org/fr/", "http://x.org/fr", None, "", "no scheme/", "http://a.net?q=/", "http://user@a.net:80/", "//a.net/", "x://y://z.net/", "http://.net/", "http://a-net/", "http://net-a.b/"]


def brute_rule(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("rules", [url_filter.RULES, url_filter.RULES + (("sub.example.net", "", "block"), ("example.net", "/en/1", "block"), ("example.net", "/en/1", "allow"), ("b", "/", "allow")), ()])
def test_urls(spark, rules):
    rows = [(i, u, "h", "k", 3) for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key string, depth int")
    got = {(r["page_id"]): (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, url_filter.rules_frame(spark, rules), salts=3).collect()}
    assert len(got) == len(rows)
    for i, u, *_ in rows:
        assert got[i] == brute_rule(u, rules), u
    assert url_filter.judge_urls(pages.limit(0), url_filter.rules_frame(spark, rules)).count() == 0


def brute_counts(t):
    ws = WORD.findall(t or "")
    grams = defaultdict(list)
    for i in range(len(ws) - 2):
        grams[tuple(ws[i : i + 3])].append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    texts = [None, "", " \t\n", "a b c a b c", "a a a a", "x\nx\n\n \nx y\nx", "a b c d e f a b c x d e f", "#$ <b> & 100%", "a\u00a0b c\x0bd", "one two three " * 500, " ".join(str(i) for i in range(5000)), "é ß\né ß\né ß"]
    d = spark.createDataFrame([(i, t, "en", 1, "q") for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int, words string")
    labels = spark.createDataFrame([(0, 1), (0, None), (None, 1)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.judge_quality(d, labels).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], brute_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge_quality(d.limit(0), labels.limit(0)).count() == 0


def test_binomial_bound_is_exact(spark):
    rows = [(n, k) for n in (10, 100, 1000, 5000) for k in (0, 1, 3, 12, 60) if k <= n]
    got = spark.createDataFrame(rows, "n long, k long").withColumn("p", quality_rules.binomial_cdf(F.col("n"), F.col("k"), 0.0125)).collect()
    for r in got:
        n, k, p = r["n"], r["k"], Fraction(1, 80)
        want = 1.0 if k >= n * p else float(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)))
        assert r["p"] == pytest.approx(want, rel=1e-9)


def test_cutoffs_keep_good_documents(spark):
    """Good texts have few symbols, bad ones many: a cutoff is proven for the large stratum only, and good documents stay."""
    rows = [(i, "word " * 60 + "".join(f"u{i}x{k} " for k in range(40)) + ("$$$ " * 200 if i % 10 == 0 else ""), "en") for i in range(900)] + [(1000 + i, "wort " * 3 + " ".join(f"v{i}y{k}" for k in range(60)) + " $$$" * 50, "de") for i in range(20)]
    rows = [(i, " ".join(f"{w}{j}" if w in ("word", "wort") else w for j, w in enumerate(t.split())), lang) for i, t, lang in rows]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0)) for i in range(900)] + [(1000 + i, 1) for i in range(20)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.judge_quality(d, labels).collect()}
    good = [got[i]["kept"] for i in range(900) if i % 10]
    assert all(good) and not any(got[i]["kept"] for i in range(0, 900, 10))
    assert not any("m_" in got[1000 + i]["failed_rules"] for i in range(20))


def brute_cutoffs(rows, most=Fraction(1, 20), delta=0.05):
    """Lowest proven cutoff of each (stratum, measure) by exact binomial sums; rows: (stratum, measures of one good document that passes the base rule)."""
    strata, rules = {s for s, _ in rows}, len(quality_rules.MEASURES)
    out = {}
    for s in strata:
        good = [m for x, m in rows if x == s]
        for r, name in enumerate(quality_rules.MEASURES):
            for c in sorted(quality_rules.CUTOFFS, reverse=True):
                n, k, p = len(good), sum(m[r] > c for m in good), float(most / rules)
                if k >= n * p or sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)) > delta / (len(strata) * rules):
                    break
                out[s, name] = c
    return out


def test_cutoffs_of_several_strata(spark):
    """The bound is divided by the number of strata, not of candidates: 470 good documents prove a cutoff among three strata and a tiny one."""
    rows, i = [], 0
    for s, n in (("de", 470), ("en", 500), ("fr", 900), ("xx", 7)):
        for k in range(n):
            m = [(k * 7) % 4 + (60 if k % 450 == 449 else 0), 25 + (k % 3), 0, 101 if k == 5 else 3]
            rows.append((i, s, 100, 10, *m))
            i += 1
    spec = "doc_id long, stratum string, n_words long, n_repeat_words long, " + ", ".join(f"{m} long" for m in quality_rules.MEASURES)
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    got = {(r["stratum"], r["measure"]): r["cutoff"] for r in quality_rules.learn_cutoffs(spark.createDataFrame(rows, spec), labels).collect()}
    want = brute_cutoffs([(r[1], r[4:]) for r in rows])
    assert got == want and {s for s, _ in want} == {"de", "en", "fr"}


def test_op6_equals_its_sql_where_cutoffs_act(spark, tmp_path):
    """The registered query and its SQL on 1,500 documents of three languages, each with enough labels for a proof."""
    import duckdb

    rows, labels, i = [], [], 0
    for lang, n in (("de", 480), ("en", 520), (None, 500)):
        for k in range(n):
            bad = k % 12 == 0
            rows.append((i, " ".join(f"w{i}x{j}" for j in range(55)) + (" $$$$$$$$" * 30 if bad else "") + (" # #" if k % 9 == 4 else ""), lang, "s", 1))
            labels.append((i, int(not bad)))
            i += 1
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.repartition(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").repartition(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(map(tuple, quality_rules.op6_quality_rules(spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    assert got == sorted(con.execute(quality_rules.OP6_SQL).fetchall())
    assert sum("m_symbols" in r[-1] for r in got) == sum(1 for x in labels if not x[1])
