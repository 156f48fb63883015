import pytest
from pyspark.sql import functions as F

from tidekb.operators import logs as G
from tidekb.operators import timeseries as T
from tidekb.sources import corpus as C
from tidekb.sources import sheets as S
from tidekb.sources import tables as W
from tidekb.streaming import jobs as J
from tidekb.streaming import versions


def test_markdown_files(spark, tmp_path):
    for d, name, body in (("markdown", "2024-05-06_x.md", "no header"), ("other", "b.md", "# Title 20240102\n\n- **來源 URL**: https://e.org/1\n\n---\nbody")):
        (tmp_path / d).mkdir()
        (tmp_path / d / name).write_text(body, encoding="utf-8")
    files = C.attach_collection(C.read_markdown(spark, [str(tmp_path / "markdown"), str(tmp_path / "other")]), {"markdown": ("meeting", "seo-meetings")})
    got = {r["source_file"]: r for r in C.parse_header(files).collect()}
    a, b = got["2024-05-06_x.md"], got["b.md"]
    assert (a["source_type"], a["source_collection"], a["source_date"], a["source_url"]) == ("meeting", "seo-meetings", "2024-05-06", None)
    assert (b["source_type"], b["source_collection"], b["source_title"], b["source_date"], b["source_url"]) == ("article", "other", "Title 20240102", "2024-01-02", "https://e.org/1")


def test_knowledge_base_file_and_log(spark, tmp_path):
    (tmp_path / "kb.json").write_text('{"total_count": 1,\n "qa_database": [{"question": "q", "keywords": ["a"]}]}', encoding="utf-8")
    r = C.read_knowledge_base(spark, "", str(tmp_path / "kb.json"), False).first()
    assert r["question"] == "q" and r["keywords"] == ["a"] and r["answer"] is None
    (tmp_path / "log.jsonl").write_text('{"event": "a", "n": 1}\n{broken\n{"event": "b", "n": 2}\n', encoding="utf-8")
    assert sorted(x["event"] for x in C.read_log(spark, str(tmp_path / "log.jsonl"), "event string, n long").collect()) == ["a", "b"]


def test_snapshot_is_written_once_per_content(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") * 2).alias("v"))
    args = ("step", str(tmp_path / "registry"), str(tmp_path / "data"))
    a = W.record_snapshot(spark, df, *args, "2024-01-01")
    b = W.record_snapshot(spark, df.repartition(4).orderBy(F.desc("id")), *args, "2024-01-02")
    c = W.record_snapshot(spark, df.filter("id > 0"), *args, "2024-01-03")
    reg = spark.read.schema(W.REGISTRY_SCHEMA).parquet(args[1])
    assert a == b != c and reg.count() == 2 and W.latest_versions(reg).first()["version"] == 2
    assert [r["version"] for r in W.version_history(reg, "step").collect()] == [2, 1]
    assert W.label_version(reg, "step", 1, "gold").filter("label = 'gold'").count() == 1


def test_export_and_kpis(spark, tmp_path):
    df = spark.createDataFrame([(1, "q1", "a1", ["k"], "c1"), (2, "q2", "a2", ["k"], "c2"), (3, "q3", "a3", ["k"], "c1")], "seq long, question string, answer string, keywords array<string>, category string")
    W.export_markdown(df, str(tmp_path / "md"))
    text = "\n".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "md" / "category=c1").glob("*.txt")))
    assert text.startswith("## c1 (2)") and text.index("q1") < text.index("q3")
    W.append_kpis(spark.createDataFrame([("20240102", 5)], "date string, health_score long"), str(tmp_path / "kpi"))
    W.append_kpis(spark.createDataFrame([("2024-01-03", 3.5)], "date string, eeat_avg double"), str(tmp_path / "kpi"))
    assert sorted(str(r["date"]) for r in W.read_kpis(spark, str(tmp_path / "kpi")).collect()) == ["2024-01-02", "2024-01-03"]


def test_metric_sheet_rules(spark):
    text = "title\n\n\t月趨勢\t上週\tMax\tMin\tSparklines\t2024/1/8\t2024/1/1\nCTR\t-3.61%\t5\t1,000\t2\t\t7\t8\nSparklines\t1%\nCTR\t1%\t2%\t3\t4\t\t5\t6\n"
    r = S.parse_metric_sheets(spark.createDataFrame([("s", text)], "sheet string, text string")).collect()
    assert len(r) == 1 and r[0]["monthly"] == 0.01 and r[0]["latest"] == 5.0 and r[0]["latest_date"] == "2024/1/8"
    one = S.parse_metric_sheets(spark.createDataFrame([("s", "\t月趨勢\nCTR\t5\t6%\n")], "sheet string, text string")).first()
    assert one["monthly"] is None and one["weekly"] == 0.06 and one["latest"] is None


def test_segment_sheet_section(spark):
    text = "x\t變化\n/before/\t1%\n全網域\t1%\n檢索未索引 (全部)\t2%\n/a/\t3%\t1\t1,000\n總合/全網域\t4%\n差距\t5%\n/after/\t6%"
    got = [(r["segment"], r["row_type"]) for r in S.parse_segment_sheets(spark.createDataFrame([("s", text)], "sheet string, text string")).orderBy("line_no").collect()]
    assert got == [("全網域", "domain"), ("檢索未索引 (全部)", "not_indexed_total"), ("/a/", "path"), ("總合/全網域", "ratio"), ("差距", "gap")]
    free = S.parse_segment_sheets(spark.createDataFrame([("s", "h\t變化\n/a/\t3%\n/b/\t1%")], "sheet string, text string")).count()
    assert free == 2


DAY = 86_400


@pytest.fixture()
def calls(spark, tmp_path):
    rows = [("h1", t) for t in (0, 10, 3600, 7199, 7200, 9000, 14399, 14401)] + [("h2", t) for t in (5, 5, 7204, 7205)]
    df = spark.createDataFrame(rows, "query_hash string, sec long").select("query_hash", F.timestamp_seconds(F.col("sec") + DAY).alias("ts"))
    path = str(tmp_path / "calls")
    for i, (lo, hi) in enumerate([(0, 3601), (3601, 9001), (9001, 20000)]):
        df.filter((F.col("ts").cast("long") >= lo + DAY) & (F.col("ts").cast("long") < hi + DAY)).coalesce(1).write.mode("append").parquet(path)
    return df, path


def test_stream_reuse_equals_batch(spark, calls, tmp_path):
    df, path = calls
    batch = {r["query_hash"]: (r["c"], r["h"]) for r in G.cache_reuse(df).groupBy("query_hash").agg(F.sum("calls").alias("c"), F.sum("hits").alias("h")).collect()}
    assert batch == {"h1": (8, 5), "h2": (4, 2)}
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    J.run_to_files(J.cache_reuse(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("query_hash").agg(F.sum("calls").alias("c"), F.sum("hits").alias("h")).collect()
    assert {r["query_hash"]: (r["c"], r["h"]) for r in got} == batch


def test_stream_decline_equals_batch(spark, tmp_path):
    rows = [("a", i, float(v)) for i, v in enumerate([9, 8, 7, 6, 8, 7, 6, 5, 4])] + [("b", i, float(v)) for i, v in enumerate([1, 2, 3])]
    df = spark.createDataFrame(rows, "metric string, ts long, value double")
    path = str(tmp_path / "pts")
    for lo, hi in ((0, 3), (3, 6), (6, 9)):
        df.filter((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    J.run_batches(J.decline_runs(stream), J.batch_writer(str(tmp_path / "out")), str(tmp_path / "cp"))
    out = spark.read.option("basePath", str(tmp_path / "out")).parquet(str(tmp_path / "out"))
    got = {r["metric"]: r["best"] for r in out.groupBy("metric").agg(F.max_by("best", "batch_id").alias("best")).collect()}
    assert got == {r["metric"]: r["longest_decline"] for r in T.series_profile(df).collect()} == {"a": 4, "b": 0}


def test_ordered_decline_runs_take_shuffled_and_late_points(spark, tmp_path):
    """Shuffled points over micro-batches give the whole series' result; a point behind the watermark is left out."""
    import random

    rng = random.Random(4)
    points = [(m, f"2024-{1 + d // 28:02d}-{1 + d % 28:02d}", float(rng.randint(0, 9))) for m in "ab" for d in range(120)]
    blocks = [points[i::6] for i in range(6)]
    rng.shuffle(blocks)
    late = [("a", "2023-01-01", 1000.0)]
    for i, rows in enumerate([*blocks, late]):
        df = spark.createDataFrame(rows, "metric string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema("metric string, ts timestamp, value double, part int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    J.run_batches(J.ordered_decline_runs(stream, "150 days"), J.batch_writer(str(tmp_path / "out")), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("metric").agg(F.max_by("best", "batch_id").alias("best"), F.max_by("run", "batch_id").alias("run"))
    want = {}
    for m in "ab":
        values = [v for k, _, v in sorted(points) if k == m]
        run = best = 0
        for x, y in zip(values, values[1:]):
            run = run + 1 if y < x else 0
            best = max(best, run)
        want[m] = (best, run)
    assert {r["metric"]: (r["best"], r["run"]) for r in rows.collect()} == want


def test_upsert_sink_is_idempotent(spark, tmp_path):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "id long, version long, v string")
    b = spark.createDataFrame([(2, 5, "new")], "id long, version long, v string")
    write = J.upsert_sink(str(tmp_path / "t"), "id", "version")
    for batch, i in ((a, 0), (b, 1), (b, 1), (a, 0)):
        write(batch, i)
    assert {tuple(r) for r in J.read_upserted(spark, str(tmp_path / "t"), "id", "version").collect()} == {(1, 2, "y"), (2, 5, "new")}
    J.compact(spark, str(tmp_path / "t"), "id", "version")
    for batch, i in ((a, 0), (b, 1)):  # replays of batches that lie in the folded table
        write(batch, i)
    assert {tuple(r) for r in J.read_upserted(spark, str(tmp_path / "t"), "id", "version").collect()} == {(1, 2, "y"), (2, 5, "new")}


def test_compaction_is_one_step_for_readers(spark, tmp_path):
    """A reader of the version before, a batch that arrives meanwhile and a second compaction beside the first."""
    path = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(list(x), "id long, version long, v string")
    write = J.upsert_sink(path, "id", "version")
    write(rows((1, 1, "a"), (2, 1, "b")), 0)
    write(rows((1, 2, "c")), 1)
    reader = versions.read_version(spark, path)

    def fold(folded):
        write(rows((3, 1, "late")), 2)
        return J._latest(folded, "id", "version")

    number, now = versions.current(spark, path)
    versions.compact(spark, path, fold)
    assert reader.count() == 3 and number == 2
    assert {tuple(r) for r in J.read_upserted(spark, path, "id", "version").collect()} == {(1, 2, "c"), (2, 1, "b"), (3, 1, "late")}
    assert sorted(sum(versions.current(spark, path)[1]["folders"].values(), [])) == [0, 1, 2]

    def rival(folded):
        J.compact(spark, path, "id", "version")
        return folded

    with pytest.raises(RuntimeError):
        versions.compact(spark, path, rival)
    for i in range(3, 8):
        write(rows((i, 1, "x")), i)
        J.compact(spark, path, "id", "version")
    assert J.read_upserted(spark, path, "id", "version").count() == 7
    kept = [d.name for d in (tmp_path / "t").iterdir() if d.name != "_versions"]
    assert len(kept) <= 2 + 2 * versions.KEEP  # folders retired some versions ago are gone
