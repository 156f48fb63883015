import math

import pytest
from pyspark.sql import functions as F

from tidekb import rules
from tidekb.functions.ranking import positions, with_row_number
from tidekb.functions.terms import find_terms
from tidekb.operators import enrich as E
from tidekb.operators import evaluation as V
from tidekb.operators import ingest as N
from tidekb.operators import metrics as M
from tidekb.operators import reconcile as R
from tidekb.operators import reports as P
from tidekb.operators import timeseries as T


@pytest.mark.parametrize("raw,want", [("1,234.5", 1234.5), ("-3.61%", -0.0361), ("#N/A", None), ("", None), ("5d", None), ("NaN", None), ("infinity", None), ("abc%", None), (" 7 ", 7.0), ("1e3", 1000.0)])
def test_parse_cell(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "r string").select(M.parse_cell("r").alias("v")).first()["v"]
    assert got == want if want is None else math.isclose(got, want)


def series(spark, values):
    return spark.createDataFrame([("m", f"2024-01-{i + 1:02d}", float(v)) for i, v in enumerate(values)], "metric string, ts string, value double")


@pytest.mark.parametrize("values,kinds", [
    ([5, 5, 5, 5, 5], []), ([10, 10, 10], []), ([10, 10, 10, 10, 6], [("ma_deviation", "critical"), ("trend", "warning")]), ([0, 0, 0, 0, 5, 5], [("trend", "info")]),
    ([9, 8, 7, 6, 20, 2], [("ma_deviation", "critical"), ("consecutive_decline", "warning")]), ([60, 50, 40, 30, 20, 10], [("ma_deviation", "critical"), ("consecutive_decline", "critical"), ("trend", "critical")])])
def test_detectors(spark, values, kinds):
    got = [(r["type"], r["severity"]) for r in T.analyze_series(series(spark, values)).orderBy("pos").collect()]
    assert got == kinds


def test_constant_series_has_no_fit(spark):
    p = T.series_profile(series(spark, [5, 5, 5, 5])).first()
    assert p["r2"] == 0.0 and p["direction"] == "stable"


def test_row_numbers_over_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("seq")).repartition(7)
    got = [r["rn"] for r in with_row_number(df, "seq", parts=7).orderBy("seq").collect()]
    assert got == list(range(1, 1001))


def test_positions_with_a_hot_group(spark):
    """Nine rows of ten share one group; the groups, one of them null, are numbered in order of their keys."""
    g = F.when(F.col("id") % 10 > 0, F.lit("hot")).when(F.col("id") % 20 == 0, F.concat(F.lit("g"), F.col("id") % 7))
    df = spark.range(2000).select((F.col("id") * 7 % 2003).alias("k"), g.alias("g")).repartition(5)
    rows = positions(df, ["k"], ["g"], "r", "gn", parts=9).collect()
    want: dict = {}
    for r in sorted(rows, key=lambda r: r["k"]):
        want.setdefault(r["g"], []).append(r["k"])
    order = {g: i for i, g in enumerate(sorted(want, key=lambda g: (g is not None, g or "")))}
    assert len(rows) == 2000 and {(r["g"], r["k"], r["r"], r["gn"]) for r in rows} == {(g, k, i, order[g]) for g, ks in want.items() for i, k in enumerate(ks)}


def test_find_terms_order_and_null(spark):
    rows = spark.createDataFrame([("beta alpha",), (None,), ("",)], "t string").select(find_terms("t", ["alpha", "beta", "al"]).alias("f")).collect()
    assert [r["f"] for r in rows] == [["alpha", "beta", "al"], [], []]


def test_maturity_needs_second_evidence(spark):
    df = spark.createDataFrame([(1, ["machine learning"], "q", "x" * 150), (2, ["machine learning"], "q", "x" * 150 + " api"), (3, [], "what is it", "short"), (4, [], "q", "y" * 150)], "seq long, keywords array<string>, question string, answer string")
    got = {r["seq"]: r["maturity_relevance"] for r in E.maturity_level(df).collect()}
    assert got[1] is None and got[2] == "L4" and got[4] is None


def test_freshness_edges(spark):
    df = spark.createDataFrame([("2020-01-01", True), ("bad", False), ("2030-01-01", False), ("2000-01-01", False), ("2023-12-31", False)], "d string, e boolean")
    got = [r["f"] for r in df.select(E.freshness("d", "e", "2024-01-01").alias("f")).collect()]
    assert got == [1.0, 1.0, 1.0, 0.5, round(math.exp(-0.693 / 540), 4)]


def test_cjk_tokens(spark):
    df = spark.createDataFrame([(1, "SEO 索引問題 a ok")], "id long, t string")
    toks = {r["token"] for r in E.corpus_tokens(df, "id", "t").collect()}
    assert toks == {"seo", "ok", "索", "引", "問", "題", "索引", "引問", "問題"}
    syn = spark.createDataFrame([("索引", ["Index"])], "term string, synonyms array<string>")
    exp = {r["token"] for r in E.expand_tokens(df, "id", "t", syn).collect()}
    assert {"索引問題", "索引", "引問", "索引問", "index", "a"} <= exp and "索" not in exp


def test_chunks_keep_oversize_piece(spark):
    df = spark.createDataFrame([(1, "aaa\n\nbbbbbbbbbb\n\ncc\n\ndd"), (2, "intro\n## A\nxx\n## B\nyyyyyyyy"), (3, "")], "id long, t string")
    got = {}
    for r in N.split_chunks(df, "t", 8).orderBy("id", "chunk_pos").collect():
        got.setdefault(r["id"], []).append(r["chunk"])
    assert got == {1: ["aaa", "bbbbbbbbbb", "cc\n\ndd"], 2: ["intro", "\n## A\nxx", "\n## B\nyyyyyyyy"], 3: [""]}


def test_html_cleaning(spark):
    html = "<html><head><title>t</title></head><body><nav>menu</nav><h2>Head &amp; more</h2><p>Text <b>bold</b></p><script>x()</script><ul><li>one</li></ul></body></html>"
    got = spark.createDataFrame([(html,)], "h string").select(N.html_to_text("h").alias("t")).first()["t"]
    assert "menu" not in got and "x()" not in got and "## Head & more" in got and "**bold**" in got and "* one" in got and "\n\n\n" not in got


def test_restore_first_row_wins_an_id(spark):
    removed = spark.createDataFrame([(2, "f", "應如何處理「a」，才能兼顧 SEO 與執行效率？"), (1, "f", "應如何處理「a」，才能兼顧 SEO 與執行效率？"), (3, "f", "plain")], "seq long, source_file string, question string")
    rw = spark.createDataFrame([("a", "better a?")], "phrase string, rewritten string")
    cur = spark.createDataFrame([("zz",)], "stable_id string")
    got = R.restore_rewritten(cur, removed, rw).collect()
    assert [(r["seq"], r["question"]) for r in got] == [(1, "better a?")]


def test_anti_join_keeps_rows_without_id(spark):
    new = spark.createDataFrame([("a", 1), ("", 2), (None, 3), ("b", 4)], "stable_id string, n int")
    old = spark.createDataFrame([("a",), (None,)], "stable_id string")
    assert sorted(r["n"] for r in R.add_unknown(new, old).collect()) == [2, 3, 4]


def test_ndcg_counts_a_rank_once(spark):
    res = spark.createDataFrame([(1, 1, ["x"]), (1, 2, ["a", "b"]), (1, 3, ["a"])], "query_id long, rank int, categories array<string>")
    gold = spark.createDataFrame([(1, ["a", "b"], [], [], False), (2, ["a"], ["k"], [], False), (3, [], [], [], False)], "query_id long, expected_categories array<string>, expected_keywords array<string>, expected_intents array<string>, booster_sensitive boolean")
    m = {r["query_id"]: r for r in V.case_metrics(res, gold).collect()}
    assert m[1]["ndcg_at_k"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3))) and m[1]["mrr"] == 0.5 and m[1]["recall_at_k"] == 1.0
    assert m[2]["hit_rate"] == 0 and m[2]["ndcg_at_k"] == 0 and m[2]["keyword_hit_rate"] == 0 and m[3]["ndcg_at_k"] == 1.0 and m[3]["recall_at_k"] == 1.0


def test_group_scorer_hook(spark):
    import pyarrow as pa

    V.group_scorer("rank_sum", "query_id long, total long")(lambda t: pa.table({"query_id": [t["query_id"][0].as_py()], "total": [sum(t["rank"].to_pylist())]}))
    res = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "query_id long, rank int")
    assert {tuple(r) for r in V.run_group_scorer(res, "rank_sum").collect()} == {(1, 3), (2, 5)}


def test_prior_report_is_strictly_earlier(spark):
    df = spark.createDataFrame([(1, "s", "2024-01-01"), (2, "s", "2024-01-01"), (3, "s", "2024-01-08"), (4, "t", "2024-01-09")], "report_id long, series string, report_date string")
    got = {r["report_id"]: r["prior_id"] for r in T.prior_report(df, "series").collect()}
    assert got == {1: None, 2: None, 3: 2, 4: None}


def test_robots_blocks(spark):
    text = "User-agent: *\nDisallow: /\n\nUser-agent: GPTBot\nUser-agent: ClaudeBot\nAllow: /\n# note\nDisallow: /\n\nUser-agent: Bytespider\n"
    got = {r["bot"]: r["status"] for r in P.crawler_rules(spark.createDataFrame([("s", text)], "site string, text string")).collect()}
    assert got["GPTBot"] == got["ClaudeBot"] == got["Bytespider"] == "allowed" and got["cohere-ai"] == "blocked"


def test_report_sections_and_dates(spark):
    text = "## 一、a\nbody [1]\n## 二：news\n2024-03-11 and 2024-02-05~27 and 3/12 and 13/45\n## 七、z\n[1] [2]"
    df = spark.createDataFrame([(1, "2024-03-15", text)], "report_id long, report_date string, text string")
    assert df.select(P.section("text", "## 一、").alias("s")).first()["s"] == "a\nbody [1]"
    ds = df.select(P._dates(F.col("text"), F.col("report_date").cast("date")).alias("d")).first()["d"]
    assert sorted(str(d) for d in ds) == ["2024-02-05", "2024-02-27", "2024-03-11", "2024-03-12"]
    d = P.depth_scores(df).first()
    assert d["citation_integration"] == pytest.approx(0.5 * 2 / 7, abs=1e-4)


def test_numbered_sections_in_digits_and_chinese_numerals(spark):
    from tidekb.operators import reports as P

    texts = ["## Section 3：a\nbody three\n## S4、b\nfour", "## 三、a\nbody three\n### x\nmore\n## 四：b\nfour", "## 十、x\nten\n## 一、y\none", "no heading"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    got = {r["id"]: (r["a"], r["b"], r["c"]) for r in df.select("id", P.numbered_section("text", "3").alias("a"), P.numbered_section("text", "10").alias("b"), P.numbered_section("text", "1").alias("c")).collect()}
    assert got == {0: ("body three\n", "", ""), 1: ("body three\n### x\nmore\n", "", ""), 2: ("", "ten\n", "one"), 3: ("", "", "")}


def test_fan_out_follows_line_order_and_ends_with_topics(spark):
    from tidekb.operators import search as S

    alerts = spark.createDataFrame([("s", "zeta", "ALERT_DOWN", 1), ("s", "alpha", "ALERT_UP", 10), ("s", "beta", "CORE", 2)], "snapshot string, name string, flag string, line int")
    mapped = spark.createDataFrame([("beta", ["q1", "q2"])], "name string, queries array<string>")
    got = [r["query"] for r in S.fan_out_queries(alerts, mapped, topics=["t1", "q2", "t2"]).orderBy("pos").collect()]
    assert got == ["zeta", "zeta 下降", "q1", "q2", "alpha", "alpha 上升", "t1", "t2"]


def test_short_signature_keeps_accents(spark):
    from pyspark.sql import functions as F

    from tidekb.functions.text import signature

    r = spark.range(1).select(signature(F.lit("Où est-ce, là? 漢字"), 80).alias("short"), signature(F.lit("Où est-ce, là? 漢字"), 120).alias("long")).first()
    assert (r["short"], r["long"]) == ("oùestcelà漢字", "oestcel漢字")


def test_results_without_categories_count_by_their_primary_one(spark):
    from tidekb.operators import evaluation as V

    golden = spark.createDataFrame([(1, ["a"], [], [], False)], "query_id int, expected_categories array<string>, expected_keywords array<string>, expected_intents array<string>, booster_sensitive boolean")
    hits = spark.createDataFrame([(1, 1, [], "a"), (1, 2, None, "b")], "query_id int, rank int, categories array<string>, category string")
    assert V.case_metrics(hits, golden).first()["mrr"] == 1.0


def test_upper_case_letter_by_letter(spark):
    from tidekb.functions.text import upper_letters

    got = spark.createDataFrame([("erßie",), ("añß",), ("",), (None,)], "t string").select(upper_letters("t").alias("u")).collect()
    assert [r["u"] for r in got] == ["ERẞIE", "AÑẞ", "", None]


def test_workers_get_rows_by_bytes(spark):
    """Long texts reach Python workers in batches of bounded size, not of ten thousand rows."""
    from tidekb.session import BATCH_BYTES, ship_package

    ship_package(spark)
    long = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1000000) AS text")
    sizes = long.mapInArrow(lambda batches: (b.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect()
    assert max(r["n"] for r in sizes) <= BATCH_BYTES + 2_000_000 and sum(r["n"] for r in sizes) >= 40_000_000


def test_token_lists_read_a_text_once_and_equal_the_grams_of_each_word(spark):
    """Han runs come from the whole text, by no expression for each word, and give the grams of words of three characters or more."""
    import re

    han = f"[{rules.HAN_CLASS}]"
    texts = ["零點 零點計畫 ab零點c零點d  x零", "Plain WORDS a plain", "", None, "點\t零點計畫書寫\n零點", "零點計ab畫書"]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, answer string")
    syn = spark.createDataFrame([("零點", ["Nil"]), ("plain", ["flat"])], "term string, synonyms array<string>")
    other = {"零點": {"nil"}, "nil": {"零點"}, "plain": {"flat"}, "flat": {"plain"}}
    out = E.token_lists(df, "answer", syn)
    for r in out.collect():
        words = set(re.findall(r"\S+", (r["answer"] or "").lower()))
        grams = {run[i : i + n] for w in words if len(w) > 2 for run in re.findall(han + "{2,}", w) for n in (2, 3, 4) for i in range(len(run) - n + 1)}
        want = words | grams
        want |= set().union(*(other.get(t, set()) for t in want)) if want else set()
        assert set(r["tokens"] or ()) == want and len(r["tokens"] or ()) == len(want), r["answer"]
    assert "regexp_extract_all(lambda" not in out._jdf.queryExecution().analyzed().toString()
