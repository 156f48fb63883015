"""Text features and scores over a table of Markdown reports.

A report is one row; its lines and sections are arrays inside the row, so scoring needs no shuffle. Only citation
look-ups and prior-report comparisons join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidekb import rules
from tidekb.functions.text import col
from tidekb.operators.reconcile import count_literal


def _consts(xs) -> Column:
    return F.split(F.lit("\x01".join(xs)), "\x01")


def _n_contained(text: Column, xs) -> Column:
    return F.size(F.filter(_consts(xs), lambda x: F.contains(text, x)))


def _has(text: Column, xs) -> Column:
    return F.exists(_consts(xs), lambda x: F.contains(text, x))


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(" \n\t\r"))


def section(text: Column | str, header: str) -> Column:
    """Text after the first ``header`` up to the next second-level heading; empty if absent."""
    t = col(text)
    at = F.instr(t, header)
    return F.when(at > 0, F.substring_index(F.substring(t, at + len(header), F.length(t)), "\n## ", 1)).otherwise("")


def prep_section(text: Column | str, title: str) -> Column:
    """Body of the ``## title…`` section of a meeting-preparation report."""
    return F.regexp_extract(col(text), rf"(?ms)^## \Q{title}\E[^\n]*\n(.*?)(?=^## |\z)", 1)


def numbered_section(text: Column | str, n: str) -> Column:
    """Body of the section with this number, in digits or else as a Chinese numeral (``## 三、…``)."""
    form = r"(?ms)^## (?:Section\s+)?(?:S)?{}[：、:][^\n]*\n(.*?)(?=^## |\z)"
    digits, han = (F.regexp_extract(col(text), form.format(x), 1) for x in (n, rules.HAN_NUMERALS[int(n)]))
    return F.when(digits != "", digits).otherwise(han)


def distinct_refs(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)))


# ---- J0 ----
def explode_sections(df: DataFrame, text: str = "text") -> DataFrame:
    """``(…, pos, title, body)`` per second-level heading."""
    parts = F.split(F.concat(F.lit("\n"), F.col(text)), "\n## ")
    keep = [c for c in df.columns if c != text]
    s = df.select(*keep, F.posexplode(parts).alias("pos", "part")).filter("pos > 0")
    at = F.instr("part", "\n")
    return s.select(*keep, "pos", F.when(at > 0, F.substring("part", F.lit(1), at - 1)).otherwise(F.col("part")).alias("title"),
                    F.when(at > 0, F.substring("part", at + 1, F.length("part"))).otherwise("").alias("body"))


def explode_paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    ps = F.filter(F.transform(F.split(F.col(text), r"\n\n+"), trimmed), lambda p: p != "")
    return df.select(*[c for c in df.columns if c != text], F.posexplode(ps).alias("pos", "paragraph"))


def table_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """``(…, pos, cells)`` of Markdown table lines without separator rows."""
    rows = F.filter(F.transform(lines(F.col(text)), trimmed), lambda x: x.startswith("|") & ~x.rlike(r"^\|\s*:?-{3,}"))
    cells = F.transform(F.split(F.regexp_replace("line", r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    return df.select(*[c for c in df.columns if c != text], F.posexplode(rows).alias("pos", "line")).withColumn("cells", cells).drop("line")


META_SCHEMA = "eeat_avg double, maturity struct<strategy:string, process:string, keywords:string, metrics:string>, scores struct<eeat:struct<experience:double, expertise:double, authoritativeness:double, trustworthiness:double>>, generation_mode string"
CITATION_SCHEMA = "array<struct<n:int, id:string, category:string, title:string>>"


def comment_blocks(df: DataFrame, text: str = "text") -> DataFrame:
    """Trailing JSON comments as columns ``meta`` and ``citations`` (null when absent or broken)."""
    meta = F.regexp_extract(F.col(text), r"(?s)<!--\s*meeting_prep_meta\s+(\{.*?\})\s*-->", 1)
    cites = F.regexp_extract(F.col(text), r"(?s)<!--\s*citations\s+(\[.*?\])\s*-->", 1)
    return df.withColumns({"meta": F.from_json(F.when(meta != "", meta), META_SCHEMA), "citations": F.from_json(F.when(cites != "", cites), CITATION_SCHEMA)})


# ---- J1 - J10 ----
def _alert_covered(text: Column, alerts: Column) -> Column:
    """Share of alert names found as they are, without parentheses, or without the keyword mark; 1 without alerts."""

    def found(name):
        low = F.lower(name)
        core = F.trim(F.regexp_replace(low, r"\s*\(.*?\)\s*", ""))
        kw = F.trim(F.regexp_replace(low, r"^kw:\s*", ""))
        return F.contains(text, low) | ((F.length(core) >= 2) & F.contains(text, core)) | ((kw != low) & (F.length(kw) >= 2) & F.contains(text, kw))

    return F.when(F.size(alerts) > 0, F.size(F.filter(alerts, found)) / F.size(alerts)).otherwise(1.0)


def basic_scores(df: DataFrame, text: str = "text", alerts: str = "alerts") -> DataFrame:
    t = F.col(text)
    kb = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(rules.KB_LINK), F.lit(0))))
    urls = F.size(F.regexp_extract_all(section(t, "## 六、"), F.lit(r"https?://[^\s)>]+"), F.lit(0)))
    names = F.coalesce(F.col(alerts), F.array().cast("array<string>"))
    df = df.withColumns({
        "section_coverage": F.round(_n_contained(t, rules.REPORT_SECTIONS_BASIC) / len(rules.REPORT_SECTIONS_BASIC), 6),
        "kb_citations": F.least(F.lit(1.0), (kb + urls) / 6), "has_research": _has(t, rules.RESEARCH_KEYWORDS).cast("double"),
        "has_links": t.rlike(rules.KB_LINK).cast("double"), "alert_coverage": _alert_covered(F.lower(t), names), "maturity_labeled": maturity_labeled(t)})
    return df.withColumn("overall", (F.col("section_coverage") + F.col("kb_citations") + F.col("has_research") + F.col("has_links") + F.col("alert_coverage")) / 5)


def maturity_labeled(t: Column, distinct_dimensions: bool = False) -> Column:
    """Action items with a maturity step: labels / 6, or distinct dimensions / 4; .5 without a section or reference line."""
    named, six, five = section(t, "優先行動清單"), section(t, "## 六、"), section(t, "## 五、")
    s = F.when(named != "", named).when(six != "", six).otherwise(five)
    labels = F.regexp_extract_all(s, F.lit(rules.MATURITY_LABEL), F.lit(0))
    if distinct_dimensions:
        dims = F.size(F.array_distinct(F.transform(labels, lambda x: F.regexp_extract(x, r"\[(策略|流程|關鍵字|指標)", 1))))
        score = F.least(F.lit(1.0), dims / 4)
    else:
        score = F.least(F.lit(1.0), F.size(labels) / 6)
    return F.when((s == "") | ~F.contains(s, F.lit(rules.MATURITY_REFERENCE)), 0.5).when(F.size(labels) == 0, 0.0).otherwise(score)


def depth_scores(df: DataFrame, text: str = "text") -> DataFrame:
    """The ten content scores of a report."""
    t = F.col(text)
    blank = trimmed(t) == ""
    ls = lines(t)
    cross = F.size(F.filter(ls, lambda x: _has(x, rules.CAUSAL_CONNECTORS) & (_n_contained(x, rules.REPORT_METRICS) >= 2)))
    items = F.filter(ls, lambda x: x.rlike(r"^\s*(?:-|\d+\.)\s"))
    specific = F.size(F.filter(items, lambda x: x.rlike(rules.SPECIFIC_ACTIONS)))
    evidence = F.size(F.filter(F.split(t, r"\n\n+"), lambda p: p.rlike(rules.NUMBER_EVIDENCE)))
    cut = F.instr(t, "## 七、")
    body = F.when(cut > 0, F.substring(t, F.lit(1), cut - 1)).otherwise(t)
    all_refs = F.size(distinct_refs(t))
    cited = sum((F.when(section(t, m).rlike(r"\[\d+\]"), 1).otherwise(0) for m in rules.REPORT_SECTIONS), F.lit(0))
    integration = F.when(all_refs == 0, 0.0).otherwise(F.size(distinct_refs(body)) / all_refs * cited / len(rules.REPORT_SECTIONS))
    spots = [F.when(F.instr(t, k) > 0, F.substring(t, F.instr(t, k), F.lit(200))) for k in rules.QUADRANT_KEYWORDS]
    found = F.array_compact(F.array(*spots))
    quadrant = F.when(F.size(found) == 0, 0.0).when(F.exists(found, lambda x: _has(x, rules.QUADRANT_SIGNALS)), 1.0).otherwise(0.5)
    sizes = F.array_compact(F.array(*[F.when(F.instr(t, m) > 0, F.length(F.regexp_replace(section(t, m), r"\s", "")).cast("double")) for m in rules.REPORT_SECTIONS]))
    df = df.withColumn("_sz", sizes)
    n = F.size("_sz")
    mean = F.aggregate("_sz", F.lit(0.0), lambda a, x: a + x) / n
    df = df.withColumn("_mean", F.when(n > 0, mean))
    std = F.sqrt(F.aggregate("_sz", F.lit(0.0), lambda a, x: a + (x - F.col("_mean")) * (x - F.col("_mean"))) / F.size("_sz"))
    balance = F.when((F.size("_sz") < 2) | (F.col("_mean") == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - std / F.col("_mean"))))
    dual = F.size(F.filter(ls, lambda x: x.rlike(rules.WEEK_PERCENT) & x.rlike(rules.MONTH_PERCENT)))
    marked = lambda m: F.size(F.filter(ls, lambda x: F.contains(x, F.lit(m))))
    red, yellow, green = marked("🔴"), marked("🟡"), marked("🟢")
    priority = F.when(red + yellow + green == 0, 0.0).otherwise((F.least(F.lit(1.0), red / 4) + F.least(F.lit(1.0), yellow / 3) + F.least(F.lit(1.0), green / 2)) / 3)
    chain = F.regexp_count(t, F.lit(r"(?s)\*\*現象\*\*.*?\*\*原因\*\*.*?\*\*行動\*\*"))
    at = F.when(F.instr(t, "最值得投入") > 0, F.instr(t, "最值得投入")).otherwise(F.instr(t, "💡"))
    top = F.when(at == 0, 0.0).when(_has(F.substring(t, at, F.lit(300)), rules.TOP_REASONS), 1.0).otherwise(0.5)
    scores = {
        "cross_metric": F.least(F.lit(1.0), cross / 15), "action_specificity": F.when(F.size(items) == 0, 0.0).otherwise(specific / F.size(items)), "data_evidence": F.least(F.lit(1.0), evidence / 70),
        "citation_integration": integration, "quadrant": quadrant, "depth_balance": balance, "dual_frame": F.least(F.lit(1.0), dual / 15), "priority_balance": priority,
        "causal_chain": F.least(F.lit(1.0), chain / 5), "top_recommendation": top,
    }
    return df.withColumns({k: F.bround(F.when(blank, 0.0).otherwise(v), 4) for k, v in scores.items()}).drop("_sz", "_mean")


def composites(df: DataFrame, digits: int = 4) -> DataFrame:
    """Weighted composites over the columns of ``basic_scores`` and ``depth_scores``."""
    total = lambda ws: F.bround(sum((F.col(c) * w for c, w in ws.items()), F.lit(0.0)), digits)
    return df.withColumns({"composite_v2": total(rules.COMPOSITE_V2), "composite_v3": total(rules.COMPOSITE_V3)})


def judged_composite(df: DataFrame, digits: int = 4) -> DataFrame:
    """``composite_judged`` from the columns of ``composites`` and a judge's three columns, held to 0 to 5. Rows that lack
    one of the judge's columns take ``composite_v2``."""
    part = {c: F.greatest(F.lit(0.0), F.least(F.lit(float(rules.JUDGE_TOP)), F.col(c))) / rules.JUDGE_TOP if c in rules.JUDGE_COLUMNS else F.col(c) for c in rules.COMPOSITE_V2_JUDGED}
    total = F.bround(sum((part[c] * w for c, w in rules.COMPOSITE_V2_JUDGED.items()), F.lit(0.0)), digits)
    judged = F.lit(True)
    for c in rules.JUDGE_COLUMNS:
        judged = judged & F.col(c).isNotNull()
    return df.withColumn("composite_judged", F.when(judged, total).otherwise(F.col("composite_v2")))


# ---- J11 ----
def structure_checks(df: DataFrame, text: str = "text") -> DataFrame:
    """The thirteen structure checks of a meeting-preparation report, one column each."""
    t = F.col(text)
    df = comment_blocks(df, text)
    lv = rules.PREP_LEVEL
    titles = F.regexp_extract_all(t, F.lit("(?m)^## (.+)$"), F.lit(1))
    present = F.size(F.filter(_consts(rules.PREP_SECTIONS), lambda e: F.exists(titles, lambda x: x.startswith(e))))
    meta_ok = F.col("meta.eeat_avg").between(1, 5)
    for d, _ in rules.PREP_DIMENSIONS:
        meta_ok = meta_ok & F.coalesce(F.col(f"meta.maturity.{d}").rlike(f"^{lv}$"), F.lit(False))
    in_range = sum((F.regexp_count(t, F.lit(rf"(?m)^\*\*{q}\d+\s*\[")).between(lo, hi).cast("int") for q, (lo, hi) in rules.PREP_QUESTION_RANGES.items()), F.lit(0))
    q_lines = F.regexp_extract_all(t, F.lit(r"(?m)^\*\*[ABCD]\d+.*$"), F.lit(0))
    tagged = F.size(F.filter(q_lines, lambda x: x.rlike(rules.PREP_QUESTION_TAG)))
    s = {n: prep_section(t, rules.PREP_SECTIONS[n]) for n in (3, 5, 6, 7, 8, 10)}
    scores = F.regexp_extract_all(s[6], F.lit(r"(?m)^\|[^|]*\|\s*\*{0,2}\s*(\d+(?:\.\d)?)/5"), F.lit(1))
    eeat = (F.size(scores) == 4) & F.forall(scores, lambda x: x.cast("double").between(1, 5))
    levels = F.size(F.regexp_extract_all(s[8], F.lit(rf"(?m)^\|[^|]*\|\s*\*{{0,2}}\s*({lv})"), F.lit(1)))
    subs = F.filter(F.split(F.concat(F.lit("\n"), s[3]), r"\n### "), lambda x: x.rlike(r"^H\d"))
    good = F.size(F.filter(subs, lambda x: F.size(F.regexp_extract_all(x, F.lit(r"(?m)^\*\*假設\s*\d"), F.lit(0))) >= 3))
    layers = F.size(F.array_distinct(F.regexp_extract_all(s[5], F.lit(r"(?m)^\|\s*\*{0,2}\s*(L[1-5])"), F.lit(1))))
    elements = F.size(F.filter(lines(s[7]), lambda x: F.ltrim(x).startswith("|") & x.rlike(r"\d+(?:\.\d)?/5")))
    rows = F.regexp_extract_all(s[10], F.lit(r"(?m)^\|[^|]*\bP\d.*$"), F.lit(0))
    items = F.when(F.size(rows) > 0, F.size(rows)).otherwise(F.size(F.regexp_extract_all(s[10], F.lit(r"(?m)^- \[ \].*$"), F.lit(0))))
    labels = F.size(F.regexp_extract_all(s[10], F.lit(rf"\[[^\[\]]*{lv}\s*→\s*{lv}\]"), F.lit(0)))
    same = sum((F.coalesce(F.col(f"meta.maturity.{d}") == F.regexp_extract(s[8], rf"(?m)^\s*\|[^\n]*{zh}[^\n]*?({lv})", 1), F.lit(False)).cast("int") for d, zh in rules.PREP_DIMENSIONS), F.lit(0))
    has_levels = s[8].rlike(lv) & F.col("meta.maturity").isNotNull()
    return df.withColumns({
        "section_completeness": present / len(rules.PREP_SECTIONS), "metadata_valid": F.coalesce(meta_ok, F.lit(False)).cast("double"), "citation_block_valid": F.col("citations").isNotNull().cast("double"),
        "question_count_valid": in_range / len(rules.PREP_QUESTION_RANGES), "question_source_annotated": F.when(F.size(q_lines) == 0, 0.0).otherwise(tagged / F.size(q_lines)),
        "eeat_score_format": eeat.cast("double"), "maturity_level_format": (levels == 4).cast("double"),
        "s3_hypothesis_structure": F.when(F.size(subs) < 3, F.size(subs) / 3).otherwise(good / F.size(subs)), "s5_all_layers_present": layers / 5,
        "s7_seven_elements": F.least(F.lit(1.0), elements / 7), "s10_checklist_present": F.least(F.lit(1.0), items / 5), "s8_meta_maturity_consistency": F.when(has_levels, same / 4).otherwise(0.0),
        "s10_maturity_upgrade_labeled": F.when(items == 0, 0.0).otherwise(F.least(F.lit(1.0), labels / F.greatest(items * 0.3, F.lit(1.0))))})


STRUCTURE_CHECKS = ["section_completeness", "metadata_valid", "citation_block_valid", "question_count_valid", "question_source_annotated", "eeat_score_format", "maturity_level_format",
                    "s3_hypothesis_structure", "s5_all_layers_present", "s7_seven_elements", "s10_checklist_present", "s8_meta_maturity_consistency", "s10_maturity_upgrade_labeled"]


# ---- J12 ----
def grounding(df: DataFrame, kb: DataFrame, ident: str = "report_id", text: str = "text") -> DataFrame:
    """Citation checks against the knowledge base ``(id, category)``: citations are exploded and joined by id."""
    t = F.col(text)
    base = comment_blocks(df, text)
    cites = base.select(ident, F.inline("citations")).select(ident, "n", F.col("id").alias("cid"), F.col("category").alias("ccat"))
    hit = cites.join(kb.select(F.col("id").alias("cid"), F.col("category").alias("kcat"), F.lit(1).alias("_k")), "cid", "left")
    per = hit.groupBy(ident).agg(F.count("*").alias("n_cites"), F.count("_k").alias("n_found"), F.count_if(F.col("_k").isNotNull() & (F.col("ccat") == F.col("kcat"))).alias("n_same"))
    rows = F.filter(F.transform(lines(numbered_section(t, "4")), lambda x: F.split(trimmed(x), r"\|")),
                    lambda c: (F.size(c) >= 7) & (F.trim(c[1]) != "主題") & ~F.trim(c[1]).rlike("^:?-{3,}:?"))
    full = F.size(F.filter(rows, lambda c: F.forall(F.slice(c, 3, 4), lambda x: F.length(F.trim(x)) > 5)))
    inline = F.transform(distinct_refs(F.regexp_replace(t, r"(?s)<!--.*?-->", "")), lambda x: x.cast("int"))
    declared = F.array_distinct(F.filter(F.transform("citations", lambda c: c["n"]), lambda n: n.isNotNull()))
    own = base.select(ident, F.when(F.size(rows) > 0, full / F.size(rows)).otherwise(0.0).alias("s4_four_sources_populated"),
                      F.when(F.coalesce(F.size(declared), F.lit(0)) > 0, F.size(F.array_intersect(declared, inline)) / F.size(declared)).otherwise(1.0).alias("inline_citation_coverage"))
    n = F.coalesce("n_cites", F.lit(0))
    return own.join(per, ident, "left").select(
        ident, F.when(n > 0, F.col("n_found") / n).otherwise(0.0).alias("citation_id_resolution"), F.when(F.col("n_found") > 0, F.col("n_same") / F.col("n_found")).otherwise(0.0).alias("citation_category_consistency"),
        F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.abs(n - 17.5) / 17.5))).alias("citation_count_in_range"), "s4_four_sources_populated", "inline_citation_coverage")


# ---- J13 ----
def coherence(df: DataFrame, text: str = "text") -> DataFrame:
    """Alerts covered by the analysis and the analysis by the questions, action points, tagged hypotheses, citation relevance."""
    t = F.col(text)
    df = comment_blocks(df, text)
    s1, s3, s9, s10 = (numbered_section(t, n) for n in ("1", "3", "9", "10"))
    known = lambda s: F.transform(F.regexp_extract_all(s, F.lit(rules.PREP_METRIC_PATTERN), F.lit(0)), lambda x: F.trim(x))
    cells = F.transform(F.filter(lines(s1), lambda x: F.trim(x).startswith("|")), lambda x: F.trim(F.coalesce(F.get(F.split(F.trim(x), r"\|"), F.lit(1)), F.lit(""))))
    a1 = F.array_distinct(F.concat(F.filter(cells, lambda c: (c != "") & (c != "指標") & ~c.rlike("^:?-{3,}")), known(s1)))
    heads = F.transform(F.regexp_extract_all(s3, F.lit(r"(?m)^### (?:H\d+|S?\d+(?:\.\d+)?)[：:]\s*(.+?)(?:\s*[（(]|$)"), F.lit(1)), lambda x: F.trim(x))
    topics = F.regexp_extract_all(s3, F.lit(r"\*\*假設\s*\d+[（(](.+?)[）)]\*\*"), F.lit(1))
    a3 = F.array_distinct(F.concat(heads, topics, known(s3)))
    a9 = F.array_distinct(known(F.array_join(F.filter(lines(s9), lambda x: F.trim(x).startswith("- [")), "\n")))
    cover = lambda xs, ys: F.when(F.size(xs) == 0, 0.0).otherwise(F.size(F.filter(xs, lambda x: F.exists(ys, lambda y: F.contains(y, x) | F.contains(x, y) | (F.lower(x) == F.lower(y))))) / F.size(xs))
    df = df.withColumns({"_a1": a1, "_a3": a3, "_a9": a9, "_items": F.filter(F.transform(lines(s10), lambda x: F.trim(x)), lambda x: x.startswith("- ["))})
    points = F.aggregate("_items", F.lit(0.0), lambda a, x: a + F.least(F.lit(2.5), F.when(x.rlike(rules.PREP_TOOLS), 1.0).otherwise(0.0) + F.when(x.rlike(rules.PREP_VERBS), 1.0).otherwise(0.0)
                                                                        + F.when(x.rlike(r"\[(?:策略|流程|關鍵字|指標)\s*L\d+→L\d+\]"), 0.5).otherwise(0.0)))
    hyp = F.regexp_count(s3, F.lit(r"(?m)^\|\s*H\d+\w?\s*\|")) + F.regexp_count(s3, F.lit(r"\*\*假設\s*\d+"))
    tags = F.regexp_count(s3, F.lit("可驗證|需人工確認|需顧問判斷"))
    relevant, total = F.lit(0), F.lit(0)
    for n, cats in rules.PREP_SECTION_CATEGORIES.items():
        refs = F.transform(F.regexp_extract_all(numbered_section(t, n), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
        got = F.filter(F.transform(refs, lambda r: F.get(F.transform(F.filter("citations", lambda c: c["n"] == r), lambda c: c["category"]), F.lit(0))), lambda c: F.coalesce(c, F.lit("")) != "")
        total, relevant = total + F.coalesce(F.size(got), F.lit(0)), relevant + F.coalesce(F.size(F.filter(got, lambda c: F.array_contains(_consts(cats), c))), F.lit(0))
    return df.withColumns({
        "cross_section_coherence": F.when(F.size("_a1") == 0, 0.0).otherwise(cover(F.col("_a1"), F.col("_a3")) * 0.5 + cover(F.col("_a3"), F.col("_a9")) * 0.5),
        "action_points": F.when(F.size("_items") == 0, 0.0).otherwise(points / (F.size("_items") * 2.5)), "hypothesis_falsifiability": F.when(hyp == 0, 0.0).otherwise(F.least(F.lit(1.0), tags / hyp)),
        "citation_relevance": F.when(total > 0, relevant / total).otherwise(0.5)}).drop("_a1", "_a3", "_a9", "_items")


# ---- J14 ----
def novelty(df: DataFrame, by: str = "series", date: str = "report_date", ident: str = "report_id", text: str = "text") -> DataFrame:
    """Scores against the latest earlier report of the series; a first report scores 1 everywhere.

    Features are drawn once per report and joined to the prior report by id, so texts are not shuffled.
    """
    from tidekb.operators.timeseries import prior_report

    t = F.col(text)
    s2, s4, s7 = (numbered_section(t, n) for n in ("2", "4", "7"))
    topic_cells = F.transform(F.filter(lines(s4), lambda x: F.trim(x).startswith("|")), lambda x: F.trim(F.coalesce(F.get(F.split(F.trim(x), r"\|"), F.lit(1)), F.lit(""))))
    topics = F.array_distinct(F.filter(F.transform(F.filter(topic_cells, lambda c: (c != "") & ~c.rlike("^:?-{3,}") & ~c.isin("主題", "狀態")),
                                                   lambda c: F.trim(F.regexp_replace(c, r"\*?\*?\[(?:NEW|CF|ONGOING-W\d+)\]\*?\*?\s*", ""))), lambda c: c != ""))
    visible = F.regexp_replace(s7, r"(?s)<details>.*?</details>", "")
    tags = F.regexp_count(s2, F.lit(r"\[NEW\]|\[ONGOING-W\d+\]|\[CF\]|\[RESOLVED\]|\[CARRY(?:-W\d+)?\]"))
    feats = df.select(by, date, ident, F.array_distinct(F.regexp_extract_all(s2, F.lit(r"\[.*?\]\((https?://[^)]+)\)"), F.lit(1))).alias("urls"), tags.alias("tags"),
                      F.regexp_count(s2, F.lit(r"\[NEW\]")).alias("new_tags"), topics.alias("topics"), distinct_refs(visible).alias("refs"), F.regexp_count(t, F.lit("<details>")).alias("toggles"))
    prior = feats.select(F.col(ident).alias("prior_id"), F.col("urls").alias("p_urls"), F.col("topics").alias("p_topics"), F.col("refs").alias("p_refs"))
    j = prior_report(feats, by, date, ident).join(prior, "prior_id", "left")
    dist = lambda a, b: F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(1 - F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    first = F.col("prior_id").isNull()
    return j.select(
        ident, by, date, "prior_id",
        F.when(first, 1.0).when(F.col("tags") > 0, F.col("new_tags") / F.col("tags")).when(F.size("urls") == 0, 0.5).otherwise(dist("urls", "p_urls")).alias("s2_novelty"),
        F.when(first, 1.0).when(F.size("topics") == 0, 0.5).otherwise(dist("topics", "p_topics")).alias("s4_novelty"),
        F.when(first, 1.0).when(F.size("refs") == 0, 0.5).otherwise(F.size(F.array_except("refs", "p_refs")) / F.size("refs")).alias("s7_citation_novelty"),
        F.when(first | (F.col("toggles") >= 3), 1.0).when(F.col("toggles") >= 1, 0.5).otherwise(0.0).alias("toggle_structure"))


# ---- J15 ----
def _dates(text: Column, report_date: Column) -> Column:
    """Distinct valid dates of the five written forms; forms without a year take the report's year."""
    ry = F.year(report_date).cast("string")
    every = lambda p, g=0: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    mk = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")))
    part = lambda x, p, i: F.regexp_extract(x, p, i)
    iso = r"\b(\d{4})-(\d{2})-(\d{2})\b"
    span = r"\b(\d{4})-(\d{2})-(\d{2})\s*[~～–]\s*(\d{2})-(\d{2})\b"
    short = r"\b(\d{4})-(\d{2})-(\d{2})[~～–](\d{1,2})\b"
    slash = r"\b(\d{1,2})/(\d{1,2})\b"
    full = F.transform(every(iso), lambda x: mk(part(x, iso, 1), part(x, iso, 2), part(x, iso, 3)))
    ends = F.transform(every(span), lambda x: mk(part(x, span, 1), part(x, span, 4), part(x, span, 5)))
    days = F.transform(every(short), lambda x: mk(part(x, short, 1), part(x, short, 2), part(x, short, 4)))
    slashes = F.transform(every(slash), lambda x: mk(ry, part(x, slash, 1), part(x, slash, 2)))
    return F.array_distinct(F.filter(F.concat(full, ends, days, slashes), lambda d: d.isNotNull()))


def source_section_scores(df: DataFrame, text: str = "text", date: str = "report_date", window: int = 30, aliases: dict[str, str] = rules.SOURCE_ALIASES) -> DataFrame:
    """Industry section: dates near the report date, distinct sources / 5, content lines / 15. Names that ``aliases`` lists
    count as their source."""
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.create_map().cast("map<string,string>")
    s2 = numbered_section(F.col(text), "2")
    df = df.withColumn("_s2", s2)
    rd = F.col(date).try_cast("date")
    df = df.withColumn("_d", _dates(F.col("_s2"), rd))
    ls = F.transform(lines(F.col("_s2")), lambda x: F.trim(x))
    cells = F.transform(F.filter(ls, lambda x: x.startswith("|") & ~x.startswith("|--")), lambda x: F.trim(F.regexp_replace(F.coalesce(F.get(F.split(x, r"\|"), F.lit(1)), F.lit("")), r"\*\*(.+?)\*\*", "$1")))
    cells = F.filter(cells, lambda c: (c != "") & ~c.isin("來源", "日期", "標題", "事件", "狀態", "更新名稱") & ~c.rlike(r"^[\d/\-~～–\s]+$"))
    heads = F.filter(F.transform(F.regexp_extract_all("_s2", F.lit("(?m)^### (.+)$"), F.lit(1)), lambda h: F.trim(h)), lambda h: ~h.isin("Google 官方更新", "業界報導"))
    paren = F.filter(F.transform(F.regexp_extract_all("_s2", F.lit(r"[（(]([^）)\n]{1,50})[）)]"), F.lit(1)), lambda x: F.trim(x)), lambda x: x.rlike("[A-Za-z]"))
    names = F.array_distinct(F.transform(F.concat(cells, heads, paren), lambda n: F.coalesce(F.try_element_at(known, F.lower(F.trim(n))), F.lower(F.trim(n)))))
    content = F.filter(lines(F.col("_s2")), lambda x: (F.trim(x) != "") & ~x.startswith("#") & ~x.startswith("---") & ~x.startswith("|--"))
    fresh = F.size(F.filter("_d", lambda d: F.abs(F.datediff(d, rd)) <= window))
    return df.withColumns({
        "date_freshness_rate": F.when((F.size("_d") == 0) | rd.isNull(), 0.5).otherwise(fresh / F.size("_d")), "source_diversity": F.least(F.lit(1.0), F.size(names) / 5),
        "s2_content_density": F.least(F.lit(1.0), F.size(content) / 15)}).drop("_s2", "_d")


# ---- J16, G18 ----
def validate(df: DataFrame, text: str = "text", down: str = "alert_down_names") -> DataFrame:
    """Pre-publish issues as an array of codes."""
    t = F.col(text)
    six, seven = F.instr(t, "六、"), F.instr(t, "七、")
    action = F.when((six > 0) & (seven > six), F.substring(t, six, seven - six)).when((six > 0) & (seven > 0), "").when(six > 0, F.substring(t, six, F.length(t))).otherwise(t)
    names = F.coalesce(F.col(down), F.array().cast("array<string>"))
    missing = len(rules.VALIDATION_SECTIONS) - _n_contained(t, rules.VALIDATION_SECTIONS)
    issues = F.array_compact(F.array(
        F.when(missing > 0, F.concat(F.lit("missing-sections:"), missing.cast("string"))), F.when(F.length(t) < 2000, "too-short"),
        F.when(F.size(distinct_refs(t)) < 4, "few-citations"), F.when(count_literal(t, "🔴") < 2, "few-red-actions"), F.when(count_literal(t, "🟡") < 1, "no-yellow-action"),
        F.when((F.size(names) > 0) & (F.size(F.filter(names, lambda n: F.contains(action, n))) / F.size(names) < 0.5), "alert-coverage")))
    return df.withColumn("issues", issues)


def kpi_rows(df: DataFrame, alerts: DataFrame, by: str = "snapshot", text: str = "text") -> DataFrame:
    """One KPI row per report: health score, alert counts, citations, action marks, length."""
    t = F.col(text)
    health = F.regexp_extract(t, r"Health Score[：:]\s*(\d+)", 1)
    counts = alerts.groupBy(by).agg(*[F.count_if(F.col("flag") == f).alias(n) for f, n in (("ALERT_DOWN", "alert_down"), ("ALERT_UP", "alert_up"), ("CORE", "core_alerts"))])
    k = df.select("report_id", by, F.when(health != "", health.try_cast("int")).alias("health_score"), F.size(distinct_refs(t)).alias("citations"),
                  count_literal(t, "🔴").alias("red_actions"), count_literal(t, "🟡").alias("yellow_actions"), F.length(t).alias("report_chars")).join(counts, by, "left")
    return k.fillna(0, ["alert_down", "alert_up", "core_alerts"])


# ---- J17 ----
def segment_text_scores(reports: DataFrame, segments: DataFrame, by: str, ident: str = "report_id", text: str = "text") -> DataFrame:
    """How well a text covers its segments ``(by, segment, change, value_a)``: joined on ``by``, one flag row per pair, averaged per report."""
    t = F.col(text)
    j = reports.select(ident, by, text).join(segments, by)
    at = F.expr(f"instr({text}, segment)")
    near = lambda n: F.substring(t, at, F.lit(n))
    up, down = _has(F.lower(near(300)), rules.SEGMENT_UP_WORDS), _has(F.lower(near(300)), rules.SEGMENT_DOWN_WORDS)
    right = F.when(F.col("change").isNull(), True).when(F.col("change") > 0, up).otherwise(down)
    cited = F.expr(f"contains({text}, format_number(value_a, 0))") | F.expr(f"contains({text}, cast(cast(value_a as long) as string))")
    f = j.select(ident, (at > 0).alias("m"), right.alias("r"), _has(near(500), rules.SEGMENT_ACTION_WORDS).alias("adv"), F.col("value_a").isNotNull().alias("num"), cited.alias("cit"))
    m = F.col("m")
    a = f.groupBy(ident).agg(F.count("*").alias("n"), F.count_if(m).alias("nm"), F.count_if(m & F.col("r")).alias("nr"), F.count_if(m & F.col("adv")).alias("na"), F.count_if("num").alias("nn"), F.count_if(F.col("num") & F.col("cit")).alias("nc"))
    out = reports.select(ident, _has(F.lower(t), rules.SEGMENT_SEVERITY_WORDS).cast("double").alias("has_severity")).join(a, ident, "left")
    z = F.coalesce("n", F.lit(0))
    out = out.select(
        ident, F.when(z > 0, F.col("nm") / z).otherwise(1.0).alias("path_coverage"), F.when(F.col("nm") > 0, F.col("nr") / F.col("nm")).otherwise(1.0).alias("trend_accuracy"), "has_severity",
        F.when(z > 0, F.least(F.lit(1.0), F.col("na") / F.greatest(z / 2, F.lit(1.0)))).otherwise(1.0).alias("recommendation_specificity"), F.when(F.col("nn") > 0, F.col("nc") / F.col("nn")).otherwise(1.0).alias("data_fidelity"))
    return out.withColumn("overall", (F.col("path_coverage") + F.col("trend_accuracy") + F.col("has_severity") + F.col("recommendation_specificity") + F.col("data_fidelity")) / 5)


# ---- J18 ----
def crawler_rules(robots: DataFrame, bots: list[str] | None = None, site: str = "site", text: str = "text") -> DataFrame:
    """``(site, bot, status)`` from robots texts: agent lines meet the later rules of their block, bots without rules of
    their own fall back to the wildcard."""
    bots = bots or rules.CRAWLER_BOTS
    # a blank line closes a block of agents
    blocks = robots.select(site, F.posexplode(F.split(text, r"\n[ \t\r\x0B\f]*(?=\n)")).alias("block", "_part"))
    numbered = blocks.select(site, "block", F.posexplode(F.transform(lines(F.col("_part")), trimmed)).alias("pos", "line"))
    d = F.lower(F.trim(F.regexp_extract("line", r"^([^:#]*):", 1)))
    v = F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    rows = numbered.filter(~F.col("line").startswith("#")).select(site, "block", "pos", d.alias("d"), v.alias("v")).filter("d <> ''")
    agents = rows.filter("d = 'user-agent'").select(site, "block", F.col("pos").alias("apos"), F.lower("v").alias("agent"))
    ruled = rows.filter("d IN ('allow', 'disallow')").select(site, "block", "pos", F.concat("d", F.lit(":"), "v").alias("rule"))
    hit = agents.join(ruled, [site, "block"], "left").withColumn("rule", F.when(F.col("pos") > F.col("apos"), F.col("rule")))
    per = hit.groupBy(site, "agent").agg(F.bool_or(F.coalesce(F.col("rule") == "disallow:/", F.lit(False))).alias("deny"), F.bool_or(F.coalesce(F.col("rule") == "allow:/", F.lit(False))).alias("allow"))
    want = robots.select(site, F.explode(_consts(bots)).alias("bot"))
    own = per.select(site, F.col("agent").alias("_a"), "deny", "allow")
    wild = per.filter("agent = '*'").select(site, F.col("deny").alias("wild_deny"))
    j = want.withColumn("_a", F.lower("bot")).join(own, [site, "_a"], "left").join(wild, site, "left")
    status = F.when(F.col("deny").isNotNull(), F.when(F.col("deny") & ~F.col("allow"), "blocked").otherwise("allowed")).when(F.coalesce("wild_deny", F.lit(False)), "blocked").otherwise("not_specified")
    return j.select(site, "bot", status.alias("status"))


def site_readiness(statuses: DataFrame, site: str = "site") -> DataFrame:
    blocked = F.count_if(F.col("status") == "blocked")
    return statuses.groupBy(site).agg(F.when(blocked == 0, "ready").when(blocked >= F.count("*") / 2, "blocked").otherwise("partial").alias("readiness"), blocked.alias("n_blocked"))


# ---- J19 ----
def number_citations(uses: DataFrame, ident: str = "report_id") -> DataFrame:
    """Citation numbers by first use inside each report ``(report_id, pos, id)``."""
    from pyspark.sql import Window

    first = uses.groupBy(ident, "id").agg(F.min("pos").alias("first_pos"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy(ident).orderBy("first_pos", "id")))


def citation_block(numbered: DataFrame, ident: str = "report_id") -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("n", "id")))
    return numbered.groupBy(ident).agg(F.concat(F.lit("<!-- citations "), F.to_json(items), F.lit(" -->")).alias("block"))
