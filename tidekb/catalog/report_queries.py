"""Report scoring over a report corpus that is laid out from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidekb import rules
from tidekb.catalog import inputs as I
from tidekb.catalog.base import lit, query, s_any, s_count, table
from tidekb.catalog.metric_queries import ALERTS, alerts
from tidekb.functions.layout import spread
from tidekb.operators import enrich as E
from tidekb.operators import reports as P

NL = "chr(10)"
# the same report layout as Spark SQL and as DuckDB SQL; {nl} is the line feed of each dialect
LAYOUT = """concat('Health Score：', length(text) % 101, {nl}{nl}, '## 一、總覽', {nl}, text, {nl}, '週 +3.2% 月 -1.5% 資料', {nl}{nl}, '## 二、流量', {nl}, 'CTR 下降 12.5% 導致 曝光 減少 [', length(text) % 7, ']', {nl}{nl}, '高曝光低點擊 ',
 CASE WHEN lang = 'en' THEN '建議 調整標題' ELSE '無' END, {nl}{nl}, CASE WHEN lang <> 'de' THEN concat('## 三、技術', {nl}, source, ' 1234 [', doc_id % 5, ']', {nl}{nl}) ELSE '' END, '## 四、意圖', {nl}, '**現象** a **原因** b **行動** c', {nl}{nl},
 CASE WHEN lang = 'fr' THEN concat('## 五、補充', {nl}, 'Semrush 研究 因為 排名 流量', {nl}{nl}) ELSE '' END, '## 六、優先行動清單', {nl}, '成熟度參考：流程 L2', {nl}, '- 🔴 檢查 click [流程 L2→L3]', {nl}, '- 🔴 ',
 CASE WHEN length(text) > 1000 THEN '排查 error' ELSE '觀察 x' END, {nl}, '- 🟡 注意 view', {nl}, '💡 最值得投入：', CASE WHEN lang = 'es' THEN '因為 成本' ELSE '無' END, {nl}, 'https://x.example/a /admin/item/', doc_id, {nl}{nl}, '## 七、來源', {nl}, '[1] [2] [3]', {nl})"""


def _layout(nl: str) -> str:
    return LAYOUT.replace("{nl}{nl}", f"{nl}, {nl}").replace("{nl}", nl)


def reports(spark, sf):
    d = spread(table(spark, sf, "documents"), "doc_id")
    r = d.select("*", F.expr(_layout("'\\n'")).alias("report"))
    arr = F.array(F.lit("Click"), F.lit("News(new)"), F.concat(F.lit("KW: "), "source"), F.col("lang"))
    return r.select(F.col("doc_id").alias("report_id"), F.col("source").alias("series"), "lang", F.col("report").alias("text"), arr.alias("alerts"), F.array(F.lit("click"), F.lit("error"), F.lit("zzz")).alias("alert_down_names"))


REP = f"rep AS (SELECT doc_id AS report_id, source AS series, lang, {_layout('chr(10)')} AS text, ['Click', 'News(new)', 'KW: ' || source, lang] AS alerts FROM documents)"


def sec(h: str, t: str = "text") -> str:
    return f"CASE WHEN strpos({t}, {lit(h)}) > 0 THEN split_part(substr({t}, strpos({t}, {lit(h)}) + {len(h)}), {NL} || '## ', 1) ELSE '' END"


def r6(df, *cols):
    return df.select("report_id", *[F.round(c, 6).alias(c) for c in cols])


@query("j00_sections", f"WITH {REP}, p AS (SELECT report_id, string_split({NL} || text, {NL} || '## ') AS ps FROM rep), u AS (SELECT report_id, unnest(ps) AS part, generate_subscripts(ps, 1) - 1 AS pos FROM p) SELECT report_id, pos, split_part(part, {NL}, 1) AS title, md5(substr(part, strpos(part, {NL}) + 1)) AS body FROM u WHERE pos > 0")
def _(spark, sf):
    return P.explode_sections(reports(spark, sf).select("report_id", "text")).withColumn("body", F.md5("body"))


@query("j00_paragraphs", f"WITH {REP}, p AS (SELECT report_id, list_filter(list_transform(string_split_regex(text, '\\n\\n+'), lambda x: trim(x, ' ' || {NL} || chr(9) || chr(13))), lambda x: x <> '') AS ps FROM rep) SELECT report_id, count(*) AS n, sum(length(x))::BIGINT AS chars FROM (SELECT report_id, unnest(ps) AS x FROM p) GROUP BY 1")
def _(spark, sf):
    p = P.explode_paragraphs(reports(spark, sf).select("report_id", "text"))
    return p.groupBy("report_id").agg(F.count("*").alias("n"), F.sum(F.length("paragraph")).alias("chars"))


_J1 = f"""{REP}, b0 AS (SELECT *, {s_count('text', rules.REPORT_SECTIONS_BASIC)} / 6.0 AS sc, least(1.0, (len(list_distinct(regexp_extract_all(text, {lit(rules.KB_LINK)}))) + len(regexp_extract_all({sec('## 六、')}, 'https?://[^\\s)>]+'))) / 6.0) AS kc,
 {s_any('text', rules.RESEARCH_KEYWORDS)}::INT AS hr, regexp_matches(text, {lit(rules.KB_LINK)})::INT AS hl, len(list_filter(alerts, lambda a: contains(lower(text), lower(a)) OR contains(lower(text), trim(regexp_replace(lower(a), '\\s*\\(.*?\\)\\s*', '', 'g'))) OR (starts_with(a, 'KW: ') AND contains(lower(text), lower(substr(a, 5)))))) / 4.0 AS ac,
 {sec('優先行動清單')} AS act FROM rep), b1 AS (SELECT *, (sc + kc + hr + hl + ac) / 5 AS overall, CASE WHEN NOT contains(act, '成熟度參考') THEN 0.5 ELSE least(1.0, len(regexp_extract_all(act, {lit(rules.MATURITY_LABEL)})) / 6.0) END AS ml FROM b0)"""


@query("j01_basic_scores", f"WITH {_J1} SELECT report_id, round(sc::DOUBLE,6) AS section_coverage, round(kc::DOUBLE,6) AS kb_citations, hr::DOUBLE AS has_research, hl::DOUBLE AS has_links, round(ac::DOUBLE,6) AS alert_coverage, round(overall::DOUBLE,5) AS overall FROM b1")
def _(spark, sf):
    s = P.basic_scores(reports(spark, sf))
    return r6(s, "section_coverage", "kb_citations", "has_research", "has_links", "alert_coverage").join(s.select("report_id", F.round("overall", 5).alias("overall")), "report_id")


@query("j02_maturity_labeled", f"WITH {_J1} SELECT report_id, round(ml::DOUBLE,6) AS labels, CASE WHEN NOT contains(act, '成熟度參考') THEN 0.5 ELSE 0.25 END::DOUBLE AS dimensions FROM b1")
def _(spark, sf):
    return reports(spark, sf).select("report_id", F.round(P.maturity_labeled(F.col("text")), 6).alias("labels"), P.maturity_labeled(F.col("text"), True).alias("dimensions"))


_QUAD = " OR ".join(f"(strpos(text, {lit(k)}) > 0 AND {s_any(f'substr(text, strpos(text, {lit(k)}), 200)', rules.QUADRANT_SIGNALS)})" for k in rules.QUADRANT_KEYWORDS)
_SIZES = ", ".join(f"CASE WHEN strpos(text, {lit(m)}) > 0 THEN length(regexp_replace({sec(m)}, '\\s', '', 'g')) END" for m in rules.REPORT_SECTIONS)
_CITED = " + ".join(f"regexp_matches({sec(m)}, '\\[\\d+\\]')::INT" for m in rules.REPORT_SECTIONS)
_METRICS_N = "(" + " + ".join(f"contains(x, {lit(m)})::INT" for m in rules.REPORT_METRICS) + ")"
_NUM = rules.NUMBER_EVIDENCE.replace("(?U)", "")
_DEEP = f"""{_J1}, l AS (SELECT *, string_split(text, {NL}) AS ls, list_filter([{_SIZES}], lambda z: z IS NOT NULL) AS sz FROM b1), l2 AS (SELECT *, list_filter(ls, lambda x: regexp_matches(x, '^\\s*(?:-|\\d+\\.)\\s')) AS items, list_avg(sz) AS mu FROM l),
dp AS (SELECT *, least(1.0, len(list_filter(ls, lambda x: {s_any('x', rules.CAUSAL_CONNECTORS)} AND {_METRICS_N} >= 2)) / 15.0) AS cross_metric, CASE WHEN len(items) = 0 THEN 0 ELSE len(list_filter(items, lambda x: regexp_matches(x, {lit(rules.SPECIFIC_ACTIONS.replace('(?i:title|標題|description|meta)', '(?:title|標題)'))}))) / len(items) END AS action_specificity,
 least(1.0, len(list_filter(string_split_regex(text, '\\n\\n+'), lambda p: regexp_matches(p, {lit(_NUM)}))) / 70.0) AS data_evidence,
 len(list_distinct(regexp_extract_all(split_part(text, '## 七、', 1), '\\[(\\d+)\\]', 1))) / len(list_distinct(regexp_extract_all(text, '\\[(\\d+)\\]', 1))) * ({_CITED}) / 7 AS citation_integration,
 CASE WHEN {_QUAD} THEN 1.0 ELSE 0.5 END AS quadrant, greatest(0.0, least(1.0, 1 - sqrt(list_avg(list_transform(sz, lambda v: (v - mu) * (v - mu)))) / mu)) AS depth_balance,
 least(1.0, len(list_filter(ls, lambda x: regexp_matches(x, {lit(rules.WEEK_PERCENT)}) AND regexp_matches(x, {lit(rules.MONTH_PERCENT)}))) / 15.0) AS dual_frame, (least(1.0, 2 / 4.0) + least(1.0, 1 / 3.0) + 0) / 3 AS priority_balance, 0.2 AS causal_chain,
 CASE WHEN {s_any("substr(text, strpos(text, '最值得投入'), 300)", rules.TOP_REASONS)} THEN 1.0 ELSE 0.5 END AS top_recommendation FROM l2)"""
DEEP = {"j03_cross_metric": ["cross_metric"], "j04_action_specificity": ["action_specificity"], "j05_data_evidence": ["data_evidence"], "j06_citation_integration": ["citation_integration"], "j07_quadrant_and_top": ["quadrant", "top_recommendation"],
        "j08_depth_balance": ["depth_balance"], "j09_frames_and_balance": ["dual_frame", "priority_balance", "causal_chain"]}


def _register(name, cols):
    @query(name, f"WITH {_DEEP} SELECT report_id, {', '.join(f'round_even({c}::DOUBLE, 4) AS {c}' for c in cols)} FROM dp")
    def _(spark, sf):
        return P.depth_scores(reports(spark, sf)).select("report_id", *cols)


for _name, _cols in DEEP.items():
    _register(_name, _cols)


def _w(ws, sub):
    return " + ".join(f"{w} * {sub.get(c, f'round_even({c}::DOUBLE, 4)')}" for c, w in ws.items())


_SUB = {"overall": "overall::DOUBLE", "maturity_labeled": "ml::DOUBLE"}


@query("j10_composites", f"WITH {_DEEP} SELECT report_id, round_even({_w(rules.COMPOSITE_V2, _SUB)}, 6) AS composite_v2, round_even({_w(rules.COMPOSITE_V3, _SUB)}, 6) AS composite_v3 FROM dp")
def _(spark, sf):
    c = P.composites(P.depth_scores(P.basic_scores(reports(spark, sf))), 6)
    return c.select("report_id", "composite_v2", "composite_v3")


_JUDGE = {"reasoning_depth": "report_id % 9 - 1.0", "actionability": "report_id % 4 + 0.5", "insight_originality": "CASE WHEN report_id % 7 > 0 THEN report_id % 6 / 2.0 END"}
_JUDGED = ", ".join(f"({v})::DOUBLE AS {k}" for k, v in _JUDGE.items())
_JW = {c: f"greatest(0, least(5, {c})) / 5" for c in rules.JUDGE_COLUMNS}


@query("j10_judged_composite", f"""WITH {_DEEP}, jd AS (SELECT *, {_JUDGED} FROM dp) SELECT report_id, CASE WHEN insight_originality IS NOT NULL THEN round_even({_w(rules.COMPOSITE_V2_JUDGED, _SUB | _JW)}, 6)
 ELSE round_even({_w(rules.COMPOSITE_V2, _SUB)}, 6) END AS composite_judged FROM jd""")
def _(spark, sf):
    c = P.composites(P.depth_scores(P.basic_scores(reports(spark, sf))), 6)
    c = c.withColumns({k: F.expr(f"cast({v} as double)") for k, v in _JUDGE.items()})
    return P.judged_composite(c, 6).select("report_id", "composite_judged")


# ---- meeting-preparation reports (J11 - J15) ----
PREP = """concat('## Section 0：執行摘要', '\\n', text, '\\n', '## Section 1：本週異常地圖', '\\n| 指標 | 值 |\\n|---|---|\\n| CTR | ', length(text), ' |\\n| ', source, ' | 2 |\\n', '## Section 2：業界最新動態\\n### Search News\\n| 來源 | 日期 |\\n|---|---|\\n| **', lang, ' blog** | ', d, ' |\\n[NEW] a [CF] b ',
 '[x](https://e.org/', source, ')\\n', '## Section 3：深度根因假設\\n### H1：CTR\\n**假設 1（CTR）** 可驗證\\n**假設 2** [1]\\n**假設 3** 可驗證\\n### H2：', source, '\\n**假設 1** x\\n', '## Section 4：顧問視角交叉比對\\n| 主題 | a | b | c | d | e |\\n|---|---|---|---|---|---|\\n| [NEW] ', lang,
 ' topic | knowledge base | consultant | metrics | ', CASE WHEN lang = 'en' THEN 'industry' ELSE 'x' END, ' | ok |\\n', CASE WHEN lang <> 'es' THEN '## Section 5：五層審計缺口清單\\n| **L1 技術** | a |\\n| L3 | b |\\n' ELSE '' END, '## Section 6：E-E-A-T 現況評估\\n| a | 3/5 |\\n| b | **4/5 ↑** |\\n| c | 2.5/5 |\\n| d | ',
 length(text) % 6, '/5 | [2]\\n', '## Section 7：人本七要素分析\\n| e | 3/5 | [1]\\n| f | 4/5 |\\n<details>[9]</details>\\n', '## Section 8：SEO 成熟度自評\\n| 策略 | L2 |\\n| 流程 | **L3** |\\n| 關鍵字 | L2.5 |\\n| 指標 | L1 |\\n', '## Section 9：會議提問清單\\n**A1 [NEW]**：x\\n**A2 [1]**：y\\n**A3 [CARRY-W2]**：z\\n**B1 no**\\n- [ ] CTR?\\n',
 '## Section 10：會議後行動核查表\\n| 🔴 P0 | GSC 檢查 [Process L2→L3] |\\n| P1 | b |\\n- [ ] Ahrefs 分析 [流程 L2→L3]\\n', '<!-- citations [{"n":1,"id":"', doc_id, '","category":"技術SEO"},{"n":2,"id":"', doc_id + 400, '","category":"其他"}] -->\\n',
 '<!-- meeting_prep_meta {"eeat_avg":3.2,"maturity":{"strategy":"L2","process":"L3","keywords":"L2.5","metrics":"L', 1 + length(text) % 3, '"}} -->')"""


def prep_reports(spark, sf):
    d = spread(table(spark, sf, "documents"), "doc_id").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d")), "doc_id", "left")
    return d.select(F.col("doc_id").alias("report_id"), F.col("source").alias("series"), F.col("d").alias("report_date"), F.expr(PREP).alias("text"))


@query("j11_structure_checks")
def _(spark, sf):
    return r6(P.structure_checks(prep_reports(spark, sf)), *P.STRUCTURE_CHECKS)


@query("j12_grounding")
def _(spark, sf):
    reports = prep_reports(spark, sf)
    cited = P.comment_blocks(reports).select(F.explode("citations.id").alias("id")).distinct()
    rows = I.kb_dated(spark, sf).withColumn("id", F.col("seq").cast("string")).join(cited, "id", "left_semi")  # only cited rows are classified
    g = P.grounding(reports, E.classify(rows).select("id", "category"))
    return r6(g, *g.columns[1:])


@query("j00_table_rows", """WITH t AS (SELECT doc_id, ['| ' || lang || ' | ' || source || ' |', '|  ' || length(text) || '|x |'] AS ls FROM documents), r AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS pos FROM t)
SELECT doc_id, pos, array_to_string(list_transform(string_split(regexp_replace(l, '^\\||\\|$', '', 'g'), '|'), lambda x: trim(x)), '/') AS cells FROM r""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    text = F.concat(F.lit("x | y\n| "), "lang", F.lit(" | "), "source", F.lit(" |\n|---|:--|\n  |  "), F.length("text").cast("string"), F.lit("|x |\nend"))
    return P.table_rows(d.select("doc_id", text.alias("text"))).select("doc_id", "pos", F.array_join("cells", "/").alias("cells"))


@query("j13_coherence")
def _(spark, sf):
    return r6(P.coherence(prep_reports(spark, sf)), "cross_section_coherence", "action_points", "hypothesis_falsifiability", "citation_relevance")


@query("j14_novelty")
def _(spark, sf):
    n = P.novelty(prep_reports(spark, sf))
    return n.select("report_id", "prior_id", *[F.round(c, 6).alias(c) for c in ("s2_novelty", "s4_novelty", "s7_citation_novelty", "toggle_structure")])


@query("j15_source_section")
def _(spark, sf):
    return r6(P.source_section_scores(prep_reports(spark, sf)), "date_freshness_rate", "source_diversity", "s2_content_density")


# ---- J16 - J19, G18 ----
_ACT = "CASE WHEN strpos(text,'七、') > strpos(text,'六、') THEN substr(text, strpos(text,'六、'), strpos(text,'七、') - strpos(text,'六、')) ELSE '' END"


@query("j16_validation", f"""WITH {REP}, i AS (SELECT report_id, list_filter([CASE WHEN {s_count('text', rules.VALIDATION_SECTIONS)} < 7 THEN 'missing-sections:' || (7 - {s_count('text', rules.VALIDATION_SECTIONS)}) END, CASE WHEN length(text) < 2000 THEN 'too-short' END,
 CASE WHEN len(list_distinct(regexp_extract_all(text, '\\[\\d+\\]'))) < 4 THEN 'few-citations' END, CASE WHEN (contains({_ACT}, 'click')::INT + contains({_ACT}, 'error')::INT + contains({_ACT}, 'zzz')::INT) / 3.0 < 0.5 THEN 'alert-coverage' END], lambda z: z IS NOT NULL) AS x FROM rep) SELECT report_id, array_to_string(x, '|') AS issues FROM i""")
def _(spark, sf):
    return P.validate(reports(spark, sf)).select("report_id", F.array_join("issues", "|").alias("issues"))


@query("g18_kpi_rows", f"""WITH {ALERTS}, {REP}, r AS (SELECT rep.*, '2024-01-' || lpad((report_id % 28 + 1)::VARCHAR, 2, '0') AS snapshot FROM rep), a AS (SELECT snapshot, count(*) FILTER (flag='ALERT_DOWN') AS alert_down, count(*) FILTER (flag='ALERT_UP') AS alert_up, count(*) FILTER (flag='CORE') AS core_alerts FROM alerts GROUP BY 1)
SELECT report_id, snapshot, regexp_extract(text, 'Health Score[：:]\\s*(\\d+)', 1)::INT AS health_score, len(list_distinct(regexp_extract_all(text, '\\[\\d+\\]'))) AS citations, 2 AS red_actions, 1 AS yellow_actions, length(text) AS report_chars, coalesce(alert_down,0) AS alert_down, coalesce(alert_up,0) AS alert_up, coalesce(core_alerts,0) AS core_alerts FROM r LEFT JOIN a USING (snapshot)""")
def _(spark, sf):
    r = reports(spark, sf).withColumn("snapshot", F.concat(F.lit("2024-01-"), F.lpad((F.col("report_id") % 28 + 1).cast("string"), 2, "0")))
    return P.kpi_rows(r, alerts(spark, sf))


@query("j17_segment_text", f"""WITH g AS (SELECT 'src' || l_suppkey AS series, '/' || l_returnflag || l_linestatus || '/' AS segment, sum(l_quantity) AS va, round(sum(l_quantity) FILTER (year(l_shipdate) = 1999) / sum(l_quantity) FILTER (year(l_shipdate) = 1998) - 1, 6) AS change FROM lineitem GROUP BY 1, 2),
r AS (SELECT doc_id AS report_id, source AS series, concat('/AF/ ', CASE WHEN lang = 'en' THEN '上升 建議' ELSE '下降' END, chr(10), text, ' /RO/ 減少 檢查 ', n_chars) AS text FROM documents),
f AS (SELECT report_id, strpos(text, segment) > 0 AS m, CASE WHEN change > 0 THEN {s_any('lower(substr(text, strpos(text, segment), 300))', rules.SEGMENT_UP_WORDS)} ELSE {s_any('lower(substr(text, strpos(text, segment), 300))', rules.SEGMENT_DOWN_WORDS)} END AS ok, {s_any('substr(text, strpos(text, segment), 500)', rules.SEGMENT_ACTION_WORDS)} AS adv,
 contains(text, format('{{:,}}', va::BIGINT)) OR contains(text, (va::BIGINT)::VARCHAR) AS cit FROM r JOIN g USING (series)),
a AS (SELECT report_id, count(*) AS n, count(*) FILTER (m) AS nm, count(*) FILTER (m AND ok) AS nr, count(*) FILTER (m AND adv) AS na, count(*) FILTER (cit) AS nc FROM f GROUP BY 1)
SELECT r.report_id, round(CASE WHEN n > 0 THEN nm / n ELSE 1 END, 6) AS path_coverage, round(CASE WHEN nm > 0 THEN nr / nm ELSE 1 END, 6) AS trend_accuracy, {s_any('lower(r.text)', rules.SEGMENT_SEVERITY_WORDS)}::INT::DOUBLE AS has_severity, round(CASE WHEN n > 0 THEN least(1.0, na / greatest(n / 2, 1.0)) ELSE 1 END, 6) AS recommendation_specificity,
 round(CASE WHEN n > 0 THEN nc / n ELSE 1 END, 6) AS data_fidelity FROM r LEFT JOIN a USING (report_id)""")
def _(spark, sf):
    l = table(spark, sf, "lineitem")
    y = F.year("l_shipdate")
    g = l.groupBy(F.concat(F.lit("src"), "l_suppkey").alias("series"), F.concat(F.lit("/"), "l_returnflag", "l_linestatus", F.lit("/")).alias("segment")).agg(
        F.sum("l_quantity").alias("value_a"), F.round(F.sum(F.when(y == 1999, F.col("l_quantity"))) / F.sum(F.when(y == 1998, F.col("l_quantity"))) - 1, 6).alias("change"))
    d = table(spark, sf, "documents")
    r = d.select(F.col("doc_id").alias("report_id"), F.col("source").alias("series"), F.concat(F.lit("/AF/ "), F.when(F.col("lang") == "en", "上升 建議").otherwise("下降"), F.lit("\n"), "text", F.lit(" /RO/ 減少 檢查 "), "n_chars").alias("text"))
    return r6(P.segment_text_scores(r, g, "series"), "path_coverage", "trend_accuracy", "has_severity", "recommendation_specificity", "data_fidelity")


# a robots text per page host, laid out from the page's language and id
def robots(spark, sf):
    p = table(spark, sf, "pages")
    lang = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    text = F.concat(F.lit("# robots\nUser-agent: *\nDisallow: "), F.when(lang == "en", "/").otherwise("/tmp"), F.lit("\n\nUser-agent: GPTBot\nUser-agent: claudebot\n"), F.when(F.length("html") > 4000, "Disallow: /\n").otherwise("Allow: /\nDisallow: /\n"),
                    F.lit("\nUser-agent: Bytespider\nDisallow: /x\n"))
    return p.select(F.col("page_id").alias("site"), text.alias("text"))


_BOTS = "(VALUES " + ", ".join(f"({lit(b)})" for b in rules.CRAWLER_BOTS) + ") AS b(bot)"
_ROB = f"""p AS (SELECT page_id AS site, regexp_extract(html, '<html lang="([a-z]+)"', 1) = 'en' AS en, length(html) > 4000 AS big FROM pages),
st AS (SELECT site, bot, CASE WHEN bot IN ('GPTBot', 'ClaudeBot') THEN CASE WHEN big THEN 'blocked' ELSE 'allowed' END WHEN bot = 'Bytespider' THEN 'allowed' WHEN en THEN 'blocked' ELSE 'not_specified' END AS status FROM p, {_BOTS})"""


@query("j18_crawler_rules", f"WITH {_ROB} SELECT site, bot, status FROM st")
def _(spark, sf):
    return P.crawler_rules(robots(spark, sf))


@query("j18_site_readiness", f"WITH {_ROB} SELECT site, CASE WHEN count(*) FILTER (status='blocked') = 0 THEN 'ready' WHEN count(*) FILTER (status='blocked') >= 5 THEN 'blocked' ELSE 'partial' END AS readiness, count(*) FILTER (status='blocked') AS n_blocked FROM st GROUP BY 1")
def _(spark, sf):
    return P.site_readiness(P.crawler_rules(robots(spark, sf)))


_USES = "f AS (SELECT l_orderkey AS report_id, l_partkey AS id, min(l_linenumber) AS first_pos FROM lineitem GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY first_pos, id) AS n FROM f)"


def uses(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_partkey").alias("id"), F.col("l_linenumber").alias("pos"))


@query("j19_citation_numbers", f"WITH {_USES} SELECT report_id, id, first_pos, n FROM n")
def _(spark, sf):
    return P.number_citations(uses(spark, sf))


@query("j19_citation_block", f"""WITH {_USES} SELECT report_id, '<!-- citations [' || string_agg('{{"n":' || n || ',"id":' || id || '}}', ',' ORDER BY n) || '] -->' AS block FROM n GROUP BY 1""")
def _(spark, sf):
    return P.citation_block(P.number_citations(uses(spark, sf)))
