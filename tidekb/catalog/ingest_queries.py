"""Ingest and reconciliation operators over documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidekb import rules
from tidekb.catalog import inputs as I
from tidekb.catalog.base import lit, query, s_any, table
from tidekb.catalog.enrich_queries import J, sql_maturity
from tidekb.functions.layout import spread
from tidekb.operators import enrich as E
from tidekb.operators import ingest as N
from tidekb.operators import reconcile as R

NL = "chr(10)"


# ---- B1, B2 ----
@query("b01_changed_pages", """WITH pg AS (SELECT page_id, o_orderdate AS last_edited FROM pages JOIN orders ON o_orderkey = page_id),
ix AS (SELECT item_id AS page_id, o_orderdate AS last_edited FROM benchmark JOIN orders ON o_orderkey = item_id WHERE o_orderstatus <> 'F'
 UNION ALL SELECT item_id, o_orderdate + INTERVAL 1 DAY FROM benchmark JOIN orders ON o_orderkey = item_id WHERE o_orderstatus = 'F')
SELECT pg.page_id, pg.last_edited::DATE::VARCHAR AS last_edited, CASE WHEN ix.page_id IS NULL THEN 'new' ELSE 'changed' END AS status FROM pg LEFT JOIN ix USING (page_id) WHERE ix.page_id IS NULL OR pg.last_edited IS DISTINCT FROM ix.last_edited""")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    pg = table(spark, sf, "pages").select("page_id").join(o, F.col("page_id") == F.col("o_orderkey")).select("page_id", F.col("o_orderdate").alias("last_edited"))
    b = table(spark, sf, "benchmark").select("item_id").join(o, F.col("item_id") == F.col("o_orderkey"))
    shifted = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("o_orderdate"))
    ix = b.select(F.col("item_id").alias("page_id"), shifted.alias("last_edited"))
    return N.changed_pages(pg, ix).withColumn("last_edited", F.col("last_edited").cast("date").cast("string"))


@query("b01_high_water_mark", "SELECT max(o_orderdate)::DATE::VARCHAR AS since, (max(o_orderdate) - INTERVAL 7 DAY)::DATE::VARCHAR AS week_before FROM orders")
def _(spark, sf):
    m = N.high_water_mark(table(spark, sf, "orders"), "o_orderdate")
    return m.select(F.col("since").cast("date").cast("string").alias("since"), N.since_timestamp("7d", F.col("since")).cast("date").cast("string").alias("week_before"))


@query("b02_new_articles", """WITH a AS (SELECT o_custkey AS guid, min(o_orderkey) AS seq, min_by(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1) SELECT guid, seq, status FROM a WHERE guid NOT IN (SELECT s_suppkey FROM supplier)""")
def _(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("guid"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("status"))
    return N.new_articles(a, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("guid")))


# ---- B3 ----
def _html_sql(src: str) -> str:
    out = src
    for pat, rep in N.MARKDOWN_STEPS:
        rep_sql = "'" + rep.replace("'", "''") + "'"
        out = f"regexp_replace({out}, {lit(pat)}, {rep_sql}, 'g')"
    for ent, ch in N.ENTITIES:
        out = f"replace({out}, {lit(ent)}, {lit(ch)})"
    for pat, rep in N.TIDY_STEPS:
        out = f"regexp_replace({out}, {lit(pat)}, '{rep}', 'g')"
    return f"trim({out}, ' ' || chr(10) || chr(9) || chr(13)) || chr(10)"


@query("b03_clean_pages", f"WITH c AS (SELECT page_id, {_html_sql('html')} AS content FROM pages) SELECT page_id, length(content) AS n, md5(content) AS digest FROM c WHERE length(content) >= 300")
def _(spark, sf):
    return N.clean_pages(spread(table(spark, sf, "pages"), "page_id")).select("page_id", F.length("content").alias("n"), F.md5("content").alias("digest"))


# ---- B4 ----
_PACK = """(SELECT list_reduce(ps, lambda a, x: CASE WHEN length(a.cur || SEP || x.cur) > 1500 AND a.cur <> '' THEN {'done': list_append(a.done, a.cur), 'cur': x.cur}
  ELSE {'done': a.done, 'cur': CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || SEP || x.cur END} END))"""


def _chunks_sql(pieces: str, sep: str, src: str) -> str:
    return f"""p AS (SELECT seq, list_transform({pieces}, lambda x: {{'done': []::VARCHAR[], 'cur': x}}) AS ps FROM {src}),
r AS (SELECT seq, {_PACK.replace('SEP', sep)} AS a FROM p), c AS (SELECT seq, unnest(list_append(a.done, a.cur)) AS chunk, generate_subscripts(list_append(a.done, a.cur), 1) - 1 AS chunk_pos FROM r)
SELECT seq, chunk_pos, length(chunk) AS n, md5(chunk) AS digest FROM c"""


@query("b04_paragraph_chunks", f"WITH {I.MD}, {_chunks_sql(f'string_split(text, {NL} || {NL})', f'{NL} || {NL}', 'md')}")
def _(spark, sf):
    c = N.split_chunks(I.markdown_docs(spark, sf).select("seq", "text"), "text", 1500)
    return c.select("seq", "chunk_pos", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


@query("b04_heading_chunks", f"""WITH h AS (SELECT doc_id AS seq, 'x' || {NL} || '## ' || replace(text, {NL}, {NL} || '## ') AS text FROM documents),
s AS (SELECT seq, list_transform(string_split(text, {NL} || '## '), lambda x, i: CASE WHEN i = 1 THEN x ELSE {NL} || '## ' || x END) AS z FROM h), {_chunks_sql('z', "''", 's')}""")
def _(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.concat(F.lit("x\n## "), F.replace("text", F.lit("\n"), F.lit("\n## "))).alias("text"))
    return N.split_chunks(d, "text", 1500).select("seq", "chunk_pos", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


# ---- B5 - B8 ----
_MARK = list(dict.fromkeys(m for ms in rules.CATEGORY_MARKERS.values() for m in ms))
# English and French markers for the test texts: the rule tables are parameters
DOC_MARKERS = ["threea", "onthe", "ation", "eaux", "leur", "schen", "ando"]
_EXC = lambda x, n: f"CASE WHEN length({x}) <= {n} THEN {x} ELSE rtrim(substr({x}, 1, {n} - 1)) || '…' END"
_EXTRACT = f"""{I.MD}, b0 AS (SELECT seq, list_transform(string_split_regex(replace(raw, {NL}, {NL} || {NL}), '\\n\\s*\\n'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'), ' -*#' || chr(9))) AS bs FROM md),
b1 AS (SELECT seq, list_filter(list_transform(bs, lambda x: {_EXC('x', 220)}), lambda x: NOT {s_any('lower(x)', rules.BOILERPLATE_MARKERS)}) AS bs FROM b0),
b2 AS (SELECT seq, bs, list_filter(bs, lambda x: length(x) >= 24 AND {s_any('lower(x)', DOC_MARKERS)}) AS m FROM b1),
b3 AS (SELECT seq, list_slice(list_filter(m, lambda x, i: list_position(m, x) = i), 1, 3) AS m, list_slice(list_filter(bs, lambda x: length(x) >= 40), 1, 2) AS f FROM b2),
seg AS (SELECT seq, CASE WHEN len(m) > 0 THEN m ELSE f END AS segs FROM b3),
k0 AS (SELECT seq, title, list_concat(list_filter([{', '.join(f"CASE WHEN contains(lower(title || {NL} || replace(raw, {NL}, {NL}||{NL})), {lit(m)}) THEN {lit(m)} END" for m in DOC_MARKERS)}], lambda z: z IS NOT NULL),
 regexp_extract_all(title, '[A-Za-z][A-Za-z0-9\\-]{{2,}}')) AS kk FROM md),
k1 AS (SELECT seq, title, list_slice(list_filter(kk, lambda z, i: list_position(kk, z) = i), 1, 6) AS kw FROM k0)"""


def extract_docs(spark, sf):
    m = I.markdown_docs(spark, sf)
    return m.select("seq", "source_file", "source_date", "title", F.replace("raw", F.lit("\n"), F.lit("\n\n")).alias("text"))


@query("b05_extract_qa", f"""WITH {_EXTRACT}, j AS (SELECT md.seq, md.source_file, md.title, md.source_date, kw, CASE WHEN len(segs) > 0 THEN segs ELSE [(SELECT {_EXC('t', 260)} FROM (SELECT trim(regexp_replace(replace(raw, {NL}, {NL}||{NL}), '\\s+', ' ', 'g'), ' -*#' || chr(9)) AS t))] END AS segs
 FROM md JOIN seg USING (seq) JOIN k1 USING (seq) WHERE len(kw) > 0 OR len(segs) > 0),
u AS (SELECT *, unnest(segs) AS s, generate_subscripts(segs, 1) - 1 AS pos FROM j),
q AS (SELECT *, CASE WHEN title <> '' THEN title ELSE '這份內容' END || ' 提到的「' || CASE WHEN len(kw) > 0 THEN kw[least(pos, len(kw) - 1) + 1] ELSE 'SEO' END || '」重點是什麼，後續應如何處理？' AS question FROM u)
SELECT seq, pos, question, CASE WHEN len(kw) > 0 THEN {J('kw')} ELSE 'SEO' END AS keywords, substr(sha256(source_file || '::' || substr(question, 1, 120)), 1, 16) AS stable_id,
 md5('[What] ' || s || ' [Why] 這表示該議題已被視為會影響搜尋可見度、索引訊號或內容策略的重點。 [How] 建議先把會議中提到的頁面、指標或設定列入排查清單，並用 Search Console、站內檢查或內容調整逐項驗證。 [Evidence] 依據' || CASE WHEN coalesce(source_date,'') <> '' THEN ' ' || source_date ELSE '' END || '內容原文可整理出上述重點。') AS digest FROM q""")
def _(spark, sf):
    q = N.extract_qa(extract_docs(spark, sf), date="source_date", markers=DOC_MARKERS, head_chars=None)
    return q.select("seq", "pos", "question", F.array_join("keywords", "|").alias("keywords"), "stable_id", F.md5("answer").alias("digest"))


@query("b06_keywords", f"WITH {_EXTRACT} SELECT seq, {J('kw')} AS keywords FROM k1")
def _(spark, sf):
    d = extract_docs(spark, sf)
    return d.select("seq", F.array_join(N.derive_keywords("title", "text", DOC_MARKERS, None), "|").alias("keywords"))


@query("b07_intro_paragraphs", f"""WITH {I.MD}, b AS (SELECT seq, list_transform(string_split(substr(text, strpos(text, '---' || {NL}) + 4), {NL} || {NL}), lambda x: trim(x, ' ' || {NL} || chr(9) || chr(13))) AS bs FROM md)
SELECT seq, array_to_string(list_slice(list_filter(list_transform(bs, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '' AND NOT starts_with(x,'#') AND NOT starts_with(x,'!')), 1, 3), '|') AS intro FROM b""")
def _(spark, sf):
    return I.markdown_docs(spark, sf).select("seq", F.array_join(N.intro_paragraphs("text"), "|").alias("intro"))


@query("b07_key_takeaways", f"""WITH l AS (SELECT doc_id AS seq, string_split(text, {NL}) AS ls FROM documents) SELECT seq, array_to_string(list_slice(list_transform(list_filter(list_slice(ls, 2, len(ls)), lambda x: trim(x) <> '' OR TRUE), lambda x: regexp_replace(ltrim(trim(x, ' ' || chr(9) || chr(13)), '* '), '\\s+', ' ', 'g')), 1, 4), '|') AS bullets FROM l""")
def _(spark, sf):
    lines = F.split("text", "\n")
    md = F.concat(F.get(lines, F.lit(0)), F.lit("\n## Key Takeaways\n"), F.array_join(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.concat(F.lit("* "), x)), "\n"), F.lit("\n## Next\n* other"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.array_join(N.key_takeaways(md), "|").alias("bullets"))


@query("b08_stable_id", f"WITH {I.KB} SELECT seq, substr(sha256(source_file || '::' || substr(question, 1, 120)), 1, 16) AS stable_id FROM kb")
def _(spark, sf):
    return I.kb(spark, sf).select("seq", N.stable_id("source_file", "question").alias("stable_id"))


# ---- B9 - B13 ----
def levels(spark, sf):
    """Rows with a partly filled level and the external table that knows some of the rest."""
    k = I.kb(spark, sf)
    l = table(spark, sf, "labels").select(F.col("doc_id").alias("seq"), F.when(F.col("quality") == 1, "L3").otherwise("").alias("maturity_relevance"),
                                          F.when(F.col("toxic") == 1, "model-b").alias("extraction_model"))
    own = F.when(F.col("lang") == "es", "L2").when(F.col("lang") == "de", "").alias("maturity_relevance")
    return k.select("*", own, F.when(F.col("lang") == "fr", "model-a").alias("extraction_model")), l


_LEVELS = f"""{I.KB}, {sql_maturity('kb', 'mat0')}, mine AS (SELECT * EXCLUDE (maturity_relevance), maturity_relevance AS rule_level, CASE lang WHEN 'es' THEN 'L2' WHEN 'de' THEN '' END AS ml, CASE lang WHEN 'fr' THEN 'model-a' END AS em FROM mat0),
ext AS (SELECT doc_id AS seq, CASE WHEN quality = 1 THEN 'L3' ELSE '' END AS xl, CASE WHEN toxic = 1 THEN 'model-b' END AS xm FROM labels),
f AS (SELECT seq, nullif(ml,'') AS ol, nullif(xl,'') AS xl, rule_level AS rl, nullif(em,'') AS om, nullif(xm,'') AS xm FROM mine LEFT JOIN ext USING (seq)),
bf AS (SELECT seq, coalesce(ol, xl, rl) AS maturity_relevance, CASE WHEN ol IS NOT NULL THEN 'existing' WHEN xl IS NOT NULL THEN 'external' WHEN rl IS NOT NULL THEN 'rule' ELSE 'missing' END AS maturity_relevance_source,
 coalesce(om, xm, 'legacy-unknown') AS extraction_model, CASE WHEN om IS NOT NULL THEN 'existing' WHEN xm IS NOT NULL THEN 'external' ELSE 'rule' END AS extraction_model_source FROM f)"""
FIELDS = ["maturity_relevance", "extraction_model"]


def backfilled(spark, sf):
    k, l = levels(spark, sf)
    k = E.maturity_level(k, "rule_level")
    return k, R.backfill(k, l, "seq", {"maturity_relevance": F.col("rule_level"), "extraction_model": F.lit("legacy-unknown")})


@query("b09_backfill", f"WITH {_LEVELS} SELECT * FROM bf")
def _(spark, sf):
    return backfilled(spark, sf)[1].select("seq", *FIELDS, *[f"{f}_source" for f in FIELDS])


@query("b09_change_log", f"""WITH {_LEVELS} SELECT seq, 'maturity_relevance' AS field, maturity_relevance AS new, maturity_relevance_source AS source FROM bf WHERE maturity_relevance_source IN ('external','rule')
UNION ALL SELECT seq, 'extraction_model', extraction_model, extraction_model_source FROM bf WHERE extraction_model_source IN ('external','rule')""")
def _(spark, sf):
    return R.change_log(backfilled(spark, sf)[1], "seq", FIELDS)


@query("b09_missing_counts", f"""WITH {_LEVELS} SELECT 'before' AS stage, count(*) FILTER (ol IS NULL) AS maturity_relevance, count(*) FILTER (om IS NULL) AS extraction_model FROM f
UNION ALL SELECT 'after', count(*) FILTER (maturity_relevance IS NULL), 0 FROM bf""")
def _(spark, sf):
    before, after = backfilled(spark, sf)
    return R.missing_counts(before, after, FIELDS)


@query("b10_model_map", """WITH r AS (SELECT o_custkey AS id, o_orderpriority AS file, o_orderkey AS pos, CASE WHEN o_totalprice > 400000 THEN o_orderstatus END AS m1, CASE WHEN o_orderpriority = '1-URGENT' THEN 'urgent' END AS m2 FROM orders)
SELECT id, coalesce(max_by(coalesce(m1, m2), (file, pos)) FILTER (coalesce(m1, m2) IS NOT NULL), 'legacy-pipeline') AS model FROM r GROUP BY 1""")
def _(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("pos"),
                                          F.when(F.col("o_totalprice") > 400000, F.col("o_orderstatus")).alias("row_model"), F.when(F.col("o_orderpriority") == "1-URGENT", "urgent").alias("file_model"))
    return R.model_map(o)


_DIFF = """l AS (SELECT doc_id AS seq, CASE WHEN quality = 1 THEN 'L3' ELSE '' END AS a, CASE WHEN toxic = 1 THEN 'm1' ELSE 'm0' END AS b FROM labels),
r AS (SELECT doc_id AS seq, CASE lang WHEN 'en' THEN 'L3' WHEN 'fr' THEN 'L1' END AS a, 'm0' AS b FROM documents),
d AS (SELECT seq, CASE WHEN l.a <> '' AND l.a IS DISTINCT FROM r.a THEN l.a END AS maturity_relevance, CASE WHEN l.b IS DISTINCT FROM r.b THEN l.b END AS extraction_model,
 list_filter([CASE WHEN l.a <> '' AND l.a IS DISTINCT FROM r.a THEN 'maturity_relevance:' || coalesce(r.a,'<NULL>') || '→' || l.a END, CASE WHEN l.b IS DISTINCT FROM r.b THEN 'extraction_model:' || r.b || '→' || l.b END], lambda z: z IS NOT NULL) AS reasons FROM l JOIN r USING (seq))"""


def diffed(spark, sf):
    l = table(spark, sf, "labels").select(F.col("doc_id").alias("seq"), F.when(F.col("quality") == 1, "L3").otherwise("").alias("maturity_relevance"), F.when(F.col("toxic") == 1, "m1").otherwise("m0").alias("extraction_model"))
    r = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.when(F.col("lang") == "en", "L3").when(F.col("lang") == "fr", "L1").alias("maturity_relevance"), F.lit("m0").alias("extraction_model"))
    return R.metadata_diff(l, r, "seq", FIELDS)


@query("b11_metadata_diff", f"WITH {_DIFF} SELECT seq, maturity_relevance, extraction_model, {J('reasons')} AS reasons FROM d WHERE len(reasons) > 0")
def _(spark, sf):
    return diffed(spark, sf).withColumn("reasons", F.array_join("reasons", "|"))


@query("b11_diff_summary", f"""WITH {_DIFF}, u AS (SELECT 'maturity_relevance' AS field, maturity_relevance AS value FROM d UNION ALL SELECT 'extraction_model', extraction_model FROM d), v AS (SELECT * FROM u WHERE value IS NOT NULL)
SELECT field, value, count(*) AS n FROM v GROUP BY 1, 2 UNION ALL SELECT field, NULL, count(*) FROM v GROUP BY 1""")
def _(spark, sf):
    return R.diff_summary(diffed(spark, sf), FIELDS)


def merged_labels(spark, sf):
    k = table(spark, sf, "documents").select(F.col("doc_id").alias("seq"), F.when(F.col("lang") == "en", "L1").alias("level"))
    r = table(spark, sf, "orders").select((F.col("o_orderkey") - 50).alias("seq"), F.when(F.col("o_orderpriority") == "2-HIGH", "L4").when(F.col("o_orderpriority") == "3-MEDIUM", "L9").when(F.col("o_orderpriority") == "1-URGENT", "L3").alias("level"), F.col("o_orderkey").alias("pos"))
    return R.merge_labels(k, r, "seq", "level", ["L1", "L2", "L3", "L4"], "pos"), r


_ML = """r AS (SELECT o_orderkey - 50 AS seq, CASE o_orderpriority WHEN '2-HIGH' THEN 'L4' WHEN '1-URGENT' THEN 'L3' END AS nl FROM orders), k AS (SELECT doc_id AS seq, CASE lang WHEN 'en' THEN 'L1' END AS lv FROM documents),
m AS (SELECT k.seq, coalesce(lv, nl) AS level, CASE WHEN nl IS NULL THEN 'untouched' WHEN lv IS NOT NULL THEN 'already-set' ELSE 'applied' END AS merge_status FROM k LEFT JOIN r USING (seq))"""


@query("b12_merge_labels", f"WITH {_ML} SELECT seq, level, merge_status FROM m")
def _(spark, sf):
    return merged_labels(spark, sf)[0].select("seq", "level", "merge_status")


@query("b12_merge_counts", f"WITH {_ML} SELECT merge_status, count(*) AS n FROM (SELECT merge_status FROM m UNION ALL SELECT 'no-match' FROM r WHERE nl IS NOT NULL AND seq NOT IN (SELECT seq FROM k)) GROUP BY 1")
def _(spark, sf):
    m, r = merged_labels(spark, sf)
    return R.merge_counts(m, r, "seq", "level", ["L1", "L2", "L3", "L4"])


@query("b13_cut_batches", "SELECT p_partkey, (floor((row_number() OVER (ORDER BY p_partkey) - 1) / ceil(count(*) OVER () / 7.0)) + 1)::INT AS batch FROM part")
def _(spark, sf):
    return R.cut_batches(table(spark, sf, "part").select("p_partkey"), "p_partkey", 7)


# ---- B14 - B16 ----
_NQ = "trim(regexp_replace(question, '\\s+', ' ', 'g'))"


@query("b14_sync_curated", f"""WITH {I.KB}, raw AS (SELECT seq, source_collection AS source_file, CASE WHEN lang = 'de' THEN 'neu ' ELSE '' END || replace(question, ' ', '  ') || ' ' AS question, upper(lang) AS answer, seq / 1000.0 AS confidence FROM kb),
cur AS (SELECT seq, source_collection AS source_file, question, answer, 0.5 AS confidence, CASE WHEN lang = 'de' AND length(answer) > 1000 THEN 'x' END AS rw FROM kb),
r AS (SELECT source_file, {_NQ} AS nq, arg_max(answer, seq) AS ra, arg_max(confidence, seq) AS rc FROM raw GROUP BY 1, 2)
SELECT seq, md5(coalesce(ra, answer)) AS answer, round(coalesce(rc, confidence)::DOUBLE, 4) AS confidence, CASE WHEN ra IS NOT NULL THEN 'matched' WHEN rw IS NOT NULL THEN 'preserved-rewritten' ELSE 'preserved-missing' END AS raw_sync_status,
 substr(sha256(cur.source_file || '::' || substr(question, 1, 120)), 1, 16) AS stable_id FROM cur LEFT JOIN r ON r.source_file = cur.source_file AND r.nq = {_NQ}""")
def _(spark, sf):
    k = I.kb(spark, sf).withColumn("source_file", F.col("source_collection"))
    changed = F.concat(F.when(F.col("lang") == "de", "neu ").otherwise(""), F.replace("question", F.lit(" "), F.lit("  ")), F.lit(" "))
    raw = k.select("seq", "source_file", changed.alias("question"), F.upper("lang").alias("answer"), (F.col("seq") / 1000).alias("confidence"))
    cur = k.select("seq", "source_file", "question", "answer", F.lit(0.5).alias("confidence"), F.lit(None).cast("string").alias("stable_id"),
                   F.when((F.col("lang") == "de") & (F.length("answer") > 1000), "x").alias("quality_rewritten_from_phrase"))
    s = R.sync_curated(cur, raw, "seq", ["answer", "confidence"])
    return s.select("seq", F.md5("answer").alias("answer"), F.round("confidence", 4).alias("confidence"), "raw_sync_status", "stable_id")


@query("b15_restore_rewritten", f"""WITH {I.KB}, {I.SYN}, rem AS (SELECT seq, source_file, keywords[1] AS phrase FROM kb WHERE len(keywords) > 0),
rw AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\\p{{L}}]{{3,}}'))) AS phrase FROM benchmark),
c AS (SELECT seq, source_file, phrase, CASE WHEN rw.phrase IS NOT NULL THEN '如何改善 ' || rem.phrase || '？' ELSE '在 SEO 實務中，' || rem.phrase || ' 的正確做法是什麼？' END AS question FROM rem LEFT JOIN rw USING (phrase)),
i AS (SELECT *, substr(sha256(source_file || '::' || substr(question, 1, 120)), 1, 16) AS stable_id FROM c)
SELECT seq, stable_id, phrase, question FROM i WHERE seq NOT IN (SELECT seq FROM kb WHERE lang = 'de')""")
def _(spark, sf):
    k = I.kb(spark, sf).filter(F.size("keywords") > 0)
    removed = k.select("seq", "source_file", "lang", F.concat(F.lit("應如何處理「"), F.col("keywords")[0], F.lit("」，才能兼顧 SEO 與執行效率？")).alias("question"))
    rw = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}]{3,}"), F.lit(0))).alias("w")).select(F.lower("w").alias("phrase")).distinct()
    rw = rw.withColumn("rewritten", F.concat(F.lit("如何改善 "), "phrase", F.lit("？")))
    everything = R.restore_rewritten(removed.limit(0).withColumn("stable_id", F.lit("")), removed, rw)
    used = everything.filter("lang = 'de'").select("stable_id")
    return R.restore_rewritten(used, removed, rw).select("seq", "stable_id", "phrase", "question")


@query("b16_inject_rows", f"""WITH {I.KB}, ex AS (SELECT seq, question, CASE WHEN lang = 'de' THEN 'booster-v1' END AS curation_tag FROM kb), bo AS (SELECT item_id AS seq, split_part(text, '.', 1) AS question, 'booster-v1' AS curation_tag FROM benchmark),
kept AS (SELECT * FROM ex WHERE curation_tag IS DISTINCT FROM 'booster-v1' AND question NOT IN (SELECT question FROM bo)), u AS (SELECT 0 AS part, * FROM kept UNION ALL SELECT 1, * FROM bo)
SELECT row_number() OVER (ORDER BY part, seq) AS row_id, question, curation_tag FROM u""")
def _(spark, sf):
    ex = I.kb(spark, sf).select("seq", "question", F.when(F.col("lang") == "de", "booster-v1").alias("curation_tag"))
    bo = table(spark, sf, "benchmark").select(F.col("item_id").alias("seq"), F.substring_index("text", ".", 1).alias("question"), F.lit("booster-v1").alias("curation_tag"))
    return R.inject_rows(ex, bo, "booster-v1").select("row_id", "question", "curation_tag")


# ---- B17 - B23 ----
def merged_rows(spark, sf):
    """One row per distinct text, with the collections that hold it."""
    return table(spark, sf, "documents").groupBy(F.md5("text").alias("text_id")).agg(
        F.min("doc_id").alias("seq"), F.min_by("source", "doc_id").alias("source_file"), F.array_sort(F.collect_set("source")).alias("merged_from"), (F.count("*") > 1).alias("is_merged"))


@query("b17_replace_source", """WITH m AS (SELECT md5(text) AS k, min(doc_id) AS seq, min_by(source, doc_id) AS sf, list(DISTINCT source) AS mf, count(*) > 1 AS im FROM documents GROUP BY 1)
SELECT seq, CASE WHEN NOT im AND sf = 'src3' THEN 'delete' WHEN im AND list_contains(mf, 'src3') THEN 'review' ELSE 'keep' END AS action FROM m""")
def _(spark, sf):
    return R.replace_source(merged_rows(spark, sf), "src3").select("seq", "action")


@query("b18_add_unknown", "SELECT doc_id FROM documents WHERE lang = 'fr' OR md5(text) NOT IN (SELECT md5(text || CASE WHEN lang = 'es' THEN ' (old)' ELSE '' END) FROM documents)")
def _(spark, sf):
    d = table(spark, sf, "documents")
    new = d.select("doc_id", F.when(F.col("lang") != "fr", F.md5("text")).alias("stable_id"))
    known = d.select(F.md5(F.concat("text", F.when(F.col("lang") == "es", " (old)").otherwise(""))).alias("stable_id"))
    return R.add_unknown(new, known).select("doc_id")


@query("b20_snapshot_diff", """WITH b AS (SELECT DISTINCT md5(text) AS stable_id FROM documents), a AS (SELECT DISTINCT md5(text || CASE WHEN lang = 'en' THEN ' (new)' ELSE '' END) AS stable_id FROM documents)
SELECT coalesce(a.stable_id, b.stable_id) AS stable_id, CASE WHEN b.stable_id IS NULL THEN 'added' ELSE 'removed' END AS change FROM b FULL JOIN a USING (stable_id) WHERE a.stable_id IS NULL OR b.stable_id IS NULL""".replace("USING (stable_id)", "ON a.stable_id = b.stable_id"))
def _(spark, sf):
    d = table(spark, sf, "documents")
    after = d.select(F.md5(F.concat("text", F.when(F.col("lang") == "en", " (new)").otherwise(""))).alias("stable_id"))
    return R.snapshot_diff(d.select(F.md5("text").alias("stable_id")), after)


@query("b21_sync_diff", """SELECT coalesce(a.d, b.d) AS day, CASE WHEN b.d IS NULL THEN 'local-only' WHEN a.d IS NULL THEN 'remote-only' ELSE 'both' END AS side FROM (SELECT DISTINCT o_orderdate::DATE::VARCHAR AS d FROM orders) a
FULL JOIN (SELECT DISTINCT l_shipdate::DATE::VARCHAR AS d FROM lineitem) b ON a.d = b.d""")
def _(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderdate").cast("date").cast("string").alias("day"))
    b = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").cast("string").alias("day"))
    return R.sync_diff(a, b, "day")


def artifacts(spark, sf):
    l = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return l.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_file"), F.when(F.col("quality") == 1, 3).alias("qa_count"), F.when(F.col("toxic") == 1, "處理失敗").otherwise("ok").alias("summary"))


_ART = "art AS (SELECT source || '/' || doc_id || '.md' AS source_file FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND toxic = 0)"


@query("b22_unprocessed", f"WITH {I.KB}, {_ART} SELECT source_file FROM kb WHERE source_file NOT IN (SELECT source_file FROM art)")
def _(spark, sf):
    return R.unprocessed(I.kb(spark, sf).select("source_file"), artifacts(spark, sf))


@query("b23_source_documents", f"WITH {I.KB_DATED} SELECT source_collection, lang AS source_title, source_date, min(seq) AS first_seq, min_by(source_file, seq) AS source_type FROM kb_dated GROUP BY 1, 2, 3")
def _(spark, sf):
    k = I.kb_dated(spark, sf).select("source_collection", F.col("lang").alias("source_title"), "source_date", F.col("source_file").alias("source_type"), "seq")
    return R.source_documents(k)


# ---- B24 - B28 ----
@query("b24_quality_filter", f"""WITH {I.KB}, q AS (SELECT seq, trim(CASE WHEN lang = 'de' THEN '關於「Conclusion」，文章提出哪些值得執行的 SEO 重點？' WHEN lang = 'es' THEN '關於「' || keywords[1] || '」' ELSE question END) AS q, trim(answer) AS a FROM kb),
r AS (SELECT seq, list_filter([CASE WHEN q = '' OR a = '' THEN 'empty-field' END, CASE WHEN {' OR '.join(f"regexp_matches(q, {lit(p)})" for p in R.GENERIC_QUESTIONS)} THEN 'generic-question-template' END,
 CASE WHEN trim(regexp_extract(q, '^關於「(.+?)」', 1)) IN ({', '.join(lit(t) for t in R.LOW_SIGNAL_TOPICS)}) THEN 'low-signal-section-heading' END,
 CASE WHEN (length(a) - length(replace(a, 'ationation', ''))) / 10 + (length(a) - length(replace(a, 'enen', ''))) / 4 >= 2 THEN 'mixed-language-placeholder-heavy' END, CASE WHEN length(a) < 80 THEN 'answer-too-short' END], lambda z: z IS NOT NULL) AS reasons FROM q)
SELECT seq, {J('reasons')} AS reasons, NOT list_has_any(reasons, ['generic-question-template', 'mixed-language-placeholder-heavy']) AS keep FROM r""")
def _(spark, sf):
    q = F.when(F.col("lang") == "de", "關於「Conclusion」，文章提出哪些值得執行的 SEO 重點？").when(F.col("lang") == "es", F.concat(F.lit("關於「"), F.get("keywords", F.lit(0)), F.lit("」"))).otherwise(F.col("question"))
    k = I.kb(spark, sf).withColumn("question", q)
    return R.quality_reasons(k, placeholders=["ationation", "enen"]).select("seq", F.array_join("reasons", "|").alias("reasons"), "keep")


@query("b25_url_map", """SELECT d.doc_id AS seq, p.url FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""")
def _(spark, sf):
    k = I.kb(spark, sf).select("seq", "source_file")
    ix = table(spark, sf, "pages").select(F.col("page_id").alias("seq"), "url").join(k, "seq").select("source_file", "url")
    m = R.url_map(ix, k.select("source_file", F.lit(None).cast("string").alias("url")))
    return k.join(m, "source_file", "left").select("seq", "url")


@query("b26_article_list", """SELECT doc_id, trim(replace(regexp_replace(f, '\\.[^.]*$', ''), '_', ' ')) AS title FROM (SELECT doc_id, source || '_' || lang || '_' || doc_id || '.md' AS f FROM documents UNION ALL SELECT doc_id, source || '_' || lang || '_note.md' FROM documents)
WHERE NOT regexp_matches(f, '_\\d{1,2}\\.md$') AND (contains(lower(f), 'fr ') OR contains(lower(trim(replace(regexp_replace(f, '\\.[^.]*$', ''), '_', ' '))), 'fr '))""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    f = d.select("doc_id", F.concat_ws("_", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("filename")).unionByName(
        d.select("doc_id", F.concat_ws("_", "source", "lang", F.lit("note.md")).alias("filename")))
    return R.article_list(f, query="fr ").select("doc_id", "title")


_FU = f"""f AS (SELECT doc_id AS seq, CASE WHEN quality = 1 THEN 0.9 ELSE 0.0234 END::DOUBLE AS old, date_diff('day', o_orderdate::DATE, DATE '{I.REF_DATE}') AS age FROM labels JOIN orders ON o_orderkey = doc_id),
n AS (SELECT seq, old, CASE WHEN age <= 0 THEN 1.0 ELSE greatest(0.01::DOUBLE, round_even(exp(-ln(2.0::DOUBLE)/540*age), 4)) END AS new_score FROM f), upd AS (SELECT * FROM n WHERE abs(new_score - old) > 0.001)"""


def fresh_updates(spark, sf):
    import math

    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("source_date"))
    l = table(spark, sf, "labels").select(F.col("doc_id").alias("seq"), F.when(F.col("quality") == 1, 0.9).otherwise(0.0234).alias("freshness_score"), F.lit(False).alias("evergreen"))
    return R.freshness_updates(l.join(o, "seq"), E.freshness("source_date", "evergreen", I.REF_DATE, floor=0.01, rate=math.log(2)))


@query("b27_freshness_updates", f"WITH {_FU} SELECT seq, round(new_score, 4) AS new_score FROM upd")
def _(spark, sf):
    return fresh_updates(spark, sf).select("seq", F.round("new_score", 4).alias("new_score"))


@query("b27_freshness_batches", f"""WITH {_FU}, p AS (SELECT *, (row_number() OVER (PARTITION BY new_score ORDER BY seq) - 1) // 100 AS batch FROM upd)
SELECT round(new_score, 4) AS new_score, batch, count(*) AS n, sum(seq)::BIGINT AS id_sum FROM p GROUP BY p.new_score, batch""")
def _(spark, sf):
    ids = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return R.freshness_batches(fresh_updates(spark, sf)).select(F.round("new_score", 4).alias("new_score"), "batch", F.size("ids").cast("long").alias("n"), ids.alias("id_sum"))


@query("b28_pipeline_status", f"""WITH {I.KB}, {_ART}, lab AS (SELECT source || '/' || doc_id || '.md' AS source_file FROM labels JOIN documents USING (doc_id))
SELECT 'extract' AS step, source_collection, count(*) FILTER (source_file IN (SELECT source_file FROM art)) AS done, count(*) FILTER (source_file NOT IN (SELECT source_file FROM art)) AS pending, count(*) AS total FROM kb GROUP BY 2
UNION ALL SELECT 'label', source_collection, count(*) FILTER (source_file IN (SELECT source_file FROM lab)), count(*) FILTER (source_file NOT IN (SELECT source_file FROM lab)), count(*) FROM kb GROUP BY 2""")
def _(spark, sf):
    k = I.kb(spark, sf).select("source_file", "source_collection")
    a = artifacts(spark, sf)
    ok = a.filter("qa_count IS NOT NULL AND summary = 'ok'")
    return R.pipeline_status({"extract": (k, ok), "label": (k, a)})
