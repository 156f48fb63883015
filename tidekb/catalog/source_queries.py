"""Sources and sinks over files that Spark writes from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidekb.catalog import inputs as I
from tidekb.catalog.base import query, table
from tidekb.session import ensure_checkpoint_dir
from tidekb.sources import corpus as C
from tidekb.sources import sheets as S
from tidekb.sources import tables as T

DIR_MAP = {"src0": ("meeting", "seo-meetings"), "src1": ("article", "blog")}


def _file(spark, sf, name, write):
    """Path of a derived file set, written once per application."""
    from tidekb.catalog import base

    key = (spark.sparkContext.applicationId, sf, name)
    if key not in base._STORED:
        import uuid

        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/files-{uuid.uuid4().hex}/{name}"
        write(path)
        base._STORED[key] = path
    return base._STORED[key]


@query("a01_corpus_scan", f"""WITH {I.MD} SELECT seq, seq || '.md' AS source_file, CASE source_collection WHEN 'src0' THEN 'meeting' ELSE 'article' END AS source_type, CASE source_collection WHEN 'src0' THEN 'seo-meetings' WHEN 'src1' THEN 'blog' ELSE source_collection END AS source_collection FROM md""")
def _(spark, sf):
    f = I.markdown_docs(spark, sf).select("seq", F.concat(F.lit("file:/corpus/"), "source_file").alias("path"))
    return C.attach_collection(f, DIR_MAP).select("seq", "source_file", "source_type", "source_collection")


@query("a02_header_fields", f"""WITH {I.MD} SELECT seq, coalesce(nullif(trim(regexp_extract(text, '(?m)^# (.+)$', 1)), ''), regexp_replace(source_file, '\\.md$', '')) AS source_title, source_date, 'https://docs.example.org/' || seq AS source_url, 'article' AS header_type, source_collection AS header_collection FROM md""")
def _(spark, sf):
    d = I.markdown_docs(spark, sf).select("seq", "source_file", "text")
    return C.parse_header(d).select("seq", "source_title", "source_date", "source_url", "header_type", "header_collection")


@query("a03_knowledge_base_scan", f"WITH {I.KB} SELECT source_collection, count(*) AS n, sum(len(keywords))::BIGINT AS keywords, sum(length(answer))::BIGINT AS chars FROM kb GROUP BY 1")
def _(spark, sf):
    def write(path):
        k = I.kb(spark, sf).select(F.lit("").alias("stable_id"), "question", "answer", "keywords", F.lit(0.5).alias("confidence"), F.lit("c").alias("category"), "source_file", "source_collection")
        k.groupBy("source_collection", F.pmod(F.xxhash64("source_file"), F.lit(64)).alias("part")).agg(F.collect_list(F.struct(*k.columns)).alias("qa_database"), F.count("*").alias("total_count")).select("total_count", "qa_database").write.json(path)

    p = _file(spark, sf, "kb_json", write)
    wrapper = C.T.StructType([C.T.StructField("qa_database", C.T.ArrayType(C.KB_SCHEMA))])
    k = spark.read.schema(wrapper).json(p).select(F.inline("qa_database"))
    return k.groupBy("source_collection").agg(F.count("*").alias("n"), F.sum(F.size("keywords")).alias("keywords"), F.sum(F.length("answer")).alias("chars"))


@query("a04_log_scan", "SELECT event_type AS event, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE user_id <> 7 GROUP BY 1")
def _(spark, sf):
    def write(path):
        e = table(spark, sf, "events")
        good = F.to_json(F.struct("event_id", F.col("event_type").alias("event"), "value"))
        e.select(F.when(F.col("user_id") == 7, F.lit('{"event_id": 1, "event": "cl')).otherwise(good).alias("value")).write.text(path)

    log = C.read_log(spark, _file(spark, sf, "log_jsonl", write), "event_id long, event string, value double")
    return log.groupBy("event").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


# ---- sheets ----
def sheets(spark, sf):
    """One tab-separated sheet per day: a title line, a header line, one line per metric."""
    c = I.metric_changes(spark, sf)
    pct = lambda x: F.coalesce(F.concat(F.format_number(F.col(x) * 100, 2), F.lit("%")), F.lit("#N/A"))
    row = F.concat_ws("\t", "name", pct("monthly"), pct("weekly"), F.format_number("value", 2), F.lit("0"), F.lit(""), F.format_number("value", 2), F.lit("1,234"))
    g = c.groupBy("snapshot").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("body"))
    d = F.replace("snapshot", F.lit("-"), F.lit("/"))
    head = F.concat(F.lit("report\n\n\t月趨勢\t上週\tMax\tMin\tSparklines\t"), d, F.lit("\t2023/12/31\n"))
    return g.select("snapshot", F.concat(head, "body", F.lit("\nSparklines\tx\n")).alias("text"))


# a percentage with a thousands comma ("1,303.51%") is not a number, as in the sheet parser
_SHEET = I.CHANGES + """, z AS (SELECT snapshot, name, value, replace(snapshot, '-', '/') AS d, monthly, weekly FROM changes)"""


@query("a05_metric_sheets", f"""WITH {_SHEET} SELECT snapshot, name, round(try_cast(format('{{:,.2f}}', monthly * 100) AS DOUBLE) / 100, 6) AS monthly, round(try_cast(format('{{:,.2f}}', weekly * 100) AS DOUBLE) / 100, 6) AS weekly,
 round(value, 2) AS latest, 1234.0::DOUBLE AS previous, d AS latest_date, '2023/12/31' AS previous_date FROM z""")
def _(spark, sf):
    m = S.parse_metric_sheets(sheets(spark, sf))
    return m.select("snapshot", "name", F.round("monthly", 6).alias("monthly"), F.round("weekly", 6).alias("weekly"), F.round("latest", 2).alias("latest"), "previous", "latest_date", "previous_date")


@query("a06_metric_history", f"WITH {_SHEET} SELECT snapshot, name, 0 AS week_idx, d AS date, round(value, 2) AS value FROM z UNION ALL SELECT snapshot, name, 1, '2023/12/31', 1234.0 FROM z")
def _(spark, sf):
    return S.metric_history(sheets(spark, sf), 4).withColumn("value", F.round("value", 2))


@query("a07_segment_sheets", """WITH g AS (SELECT l_returnflag AS site, '/s' || l_suppkey || '/' AS segment, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2), t AS (SELECT site, sum(v) AS v FROM g GROUP BY 1)
SELECT site, segment, 'path' AS row_type, round(v, 0) AS value_a FROM g UNION ALL SELECT site, '全網域', 'domain', 9.0 FROM t UNION ALL SELECT site, '檢索未索引 (全部)', 'not_indexed_total', round(v, 0) FROM t UNION ALL SELECT site, '差距', 'gap', NULL FROM t""")
def _(spark, sf):
    l = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("site"), F.concat(F.lit("/s"), "l_suppkey", F.lit("/")).alias("segment")).agg(F.sum("l_quantity").alias("v"))
    line = F.concat_ws("\t", "segment", F.lit("1.5%"), F.lit("2"), F.format_number("v", 0), F.lit("#N/A"))
    g = l.groupBy("site").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("b"), F.sum("v").alias("t"))
    text = F.concat(F.lit("x\t變化\t差異\n/ignored/\t1\n全網域\t1%\t1\t9\t9\n檢索未索引 (全部)\t2%\t3\t"), F.format_number("t", 0), F.lit("\t1\n"), "b", F.lit("\n差距\t#N/A\n/after/\t1%\t1\t1\n"))
    return S.parse_segment_sheets(g.select("site", text.alias("text"))).select("site", "segment", "row_type", F.round("value_a", 0).alias("value_a"))


# ---- vectors, artifacts ----
@query("a08_vector_check", """SELECT 'missing_vectors' AS "check", count(*) AS value FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) UNION ALL SELECT 'orphan_vectors', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'distinct_sizes', count(DISTINCT len(embedding)) FROM embeddings UNION ALL SELECT 'key_collisions', 0""")
def _(spark, sf):
    return T.check_vectors(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id")


@query("a09_stored_vectors", "SELECT doc_id, len(embedding) AS dim, round(embedding[1]::DOUBLE, 5) AS first FROM documents JOIN embeddings ON vec_id = doc_id")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("stable_id"), "embedding")
    p = _file(spark, sf, "vectors", lambda path: T.write_vectors(e, path))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("stable_id"))
    return d.join(spark.read.parquet(p), "stable_id").select(F.col("stable_id").alias("doc_id"), F.size("embedding").alias("dim"), F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("a10_artifact_union", f"""WITH {I.KB}, r AS (SELECT source_collection || '_qa.json' AS file, CASE WHEN lang = 'en' THEN source_file ELSE source_collection || '.md' END AS source_file, question FROM kb WHERE source_collection NOT IN ('src4', 'src5'))
SELECT file, count(*) AS qa_count, 0.55::DOUBLE AS avg_confidence, count(DISTINCT source_file) AS files FROM r GROUP BY 1""")
def _(spark, sf):
    k = I.kb(spark, sf)
    qa = F.struct("question", "answer", "keywords", F.lit(0.55).alias("confidence"), F.when(F.col("lang") == "en", F.col("source_file")).otherwise("").alias("source_file"))
    part = F.pmod(F.xxhash64("seq"), F.lit(64)).alias("part")
    a = k.groupBy("source_collection", part).agg(F.collect_list(qa).alias("qa_pairs"))
    summary = F.when(F.col("source_collection") == "src4", "處理失敗").otherwise("ok")
    payload = F.when(F.col("source_collection") == "src5", F.lit("{broken")).otherwise(F.to_json(F.struct(summary.alias("meeting_summary"), "qa_pairs")))
    rows = C.union_artifacts(a.select(F.concat("source_collection", F.lit("_qa.json")).alias("file"), payload.alias("payload")))
    return C.artifact_summary(rows).join(rows.groupBy("file").agg(F.count_distinct("source_file").alias("files")), "file")


# ---- snapshots ----
_LANES = ", ".join(f"sum(('0x' || substr(h, {1 + 16 * i}, 16))::UBIGINT::HUGEINT) AS s{i}" for i in range(4))
_HASH = "sha256(n || '-' || s0 || '-' || s1 || '-' || s2 || '-' || s3)"


@query("a11_content_hash", f"WITH r AS (SELECT source, sha256(doc_id || chr(31) || lang || chr(31) || text) AS h FROM documents), a AS (SELECT source, count(*) AS n, {_LANES} FROM r GROUP BY 1) SELECT source, n AS rows, {_HASH} AS content_hash FROM a")
def _(spark, sf):
    return T.content_hash(table(spark, sf, "documents").select("source", "doc_id", "lang", "text"), by=["source"])


@query("a11_versions", """WITH r AS (SELECT o_orderpriority AS step, sha256(o_orderstatus || (o_totalprice > 200000)) AS content_hash, strftime(o_orderdate, '%Y-%m-%d') || '-' || o_orderkey AS created_at FROM orders),
f AS (SELECT step, content_hash, min(created_at) AS created_at, count(*) AS runs FROM r GROUP BY 1, 2), v AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY created_at, content_hash) AS version FROM f) SELECT step, content_hash, created_at, runs, version FROM v QUALIFY version = max(version) OVER (PARTITION BY step)""")
def _(spark, sf):
    o = table(spark, sf, "orders")
    r = o.select(F.col("o_orderpriority").alias("step"), F.sha2(F.concat("o_orderstatus", (F.col("o_totalprice") > 200000).cast("string")), 256).alias("content_hash"),
                 F.concat_ws("-", F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey").cast("string")).alias("created_at"))
    return T.latest_versions(T.fold_versions(r))


@query("a12_upsert", """WITH u AS (SELECT c_custkey AS id, -1 AS version, c_mktsegment AS status, c_acctbal AS amount FROM customer UNION ALL SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM orders)
SELECT id, max(version) AS version, max_by(status, version) AS status, max_by(amount, version) AS amount, 'canonical' AS tier FROM u GROUP BY 1""")
def _(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("version"), F.col("c_mktsegment").alias("status"), F.col("c_acctbal").alias("amount"))
    new = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("amount"))
    return T.upsert(old, new, "id", "version", {"tier": F.lit("canonical")})


@query("a13_markdown_export", f"""WITH {I.KBC} SELECT category, -1 AS seq, md5('## ' || category || ' (' || count(*) || ')') AS line FROM kbc GROUP BY 1
UNION ALL SELECT category, seq, md5('### ' || question || chr(10) || chr(10) || answer || chr(10) || chr(10) || '關鍵字：' || array_to_string(keywords, ', ') || chr(10)) FROM kbc""")
def _(spark, sf):
    return T.markdown_lines(I.kb_classified(spark, sf)).select("category", "seq", F.md5("value").alias("line"))


@query("a14_kpi_log", """WITH e AS (SELECT ts::DATE AS d, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT d::VARCHAR AS date, count(*) AS records, sum(CASE WHEN event_type = 'click' THEN NULL ELSE n END)::BIGINT AS citations, max(CASE WHEN event_type = 'click' THEN n / 10.0 END)::DOUBLE AS eeat_avg FROM e GROUP BY 1""")
def _(spark, sf):
    def write(path):
        e = table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("d"), "event_type").agg(F.count("*").alias("n"))
        T.append_kpis(e.filter("event_type <> 'click'").select(F.date_format("d", "yyyyMMdd").alias("date"), F.lit("generate-report").alias("report"), F.col("n").alias("citations")), path)
        T.append_kpis(e.filter("event_type = 'click'").select(F.date_format("d", "yyyy-MM-dd").alias("date"), F.lit("meeting-prep").alias("report"), (F.col("n") / 10).alias("eeat_avg")), path)

    k = T.read_kpis(spark, _file(spark, sf, "kpis", write))
    return k.groupBy(F.col("date").cast("string").alias("date")).agg(F.count("*").alias("records"), F.sum("citations").alias("citations"), F.max("eeat_avg").alias("eeat_avg"))
