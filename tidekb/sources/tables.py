"""Tables at rest: vectors, snapshots, upsert, export, KPI log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def check_vectors(table: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """One row: ids without a vector, vectors without an id, distinct vector sizes, repeated keys."""
    miss = table.join(vectors.select(key), key, "left_anti").agg(F.count("*").alias("missing_vectors"))
    extra = vectors.join(table.select(key), key, "left_anti").agg(F.count("*").alias("orphan_vectors"))
    sizes = vectors.agg(F.count_distinct(F.size("embedding")).alias("distinct_sizes"))
    one = lambda df, n: df.select(F.lit(n).alias("check"), F.col(df.columns[0]).alias("value"))
    return one(miss, "missing_vectors").unionByName(one(extra, "orphan_vectors")).unionByName(one(sizes, "distinct_sizes")).unionByName(
        key_collisions(vectors, key).agg(F.count("*").alias("v")).select(F.lit("key_collisions").alias("check"), F.col("v").alias("value")))


def key_collisions(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def write_vectors(df: DataFrame, path: str, key: str = "stable_id") -> None:
    """Vectors as Parquet keyed by id: position in the file means nothing."""
    df.select(key, "embedding").write.mode("overwrite").parquet(path)


# ---- snapshots ----
def content_hash(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Order-independent content hash of a table (per group of ``by``): row digests are added in four 64-bit lanes.

    Addition commutes, so partial sums combine map-side and neither partitioning nor row order matters; nothing is
    collected or sorted.
    """
    cols = columns or sorted(c for c in df.columns if c not in (by or []))
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]), 256)
    lanes = [F.conv(F.substring("_h", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)").cast("decimal(38,0)") for i in range(4)]
    agg = df.select(*(by or []), digest.alias("_h")).groupBy(*(by or [])).agg(F.count("*").alias("rows"), *[F.sum(l).alias(f"_s{i}") for i, l in enumerate(lanes)])
    total = F.concat_ws("-", F.col("rows").cast("string"), *[F.coalesce(F.col(f"_s{i}"), F.lit(0)).cast("string") for i in range(4)])
    return agg.select(*(by or []), "rows", F.sha2(total, 256).alias("content_hash"))


REGISTRY_SCHEMA = "step string, version long, content_hash string, rows long, created_at string, label string, path string"


def record_snapshot(spark: SparkSession, df: DataFrame, step: str, registry_path: str, data_path: str, created_at: str, label: str | None = None) -> str:
    """Write a snapshot unless the step already holds the same content; returns the path of the content's snapshot."""
    h = content_hash(df).first()
    try:
        registry = spark.read.schema(REGISTRY_SCHEMA).parquet(registry_path).filter(F.col("step") == step)
        known = registry.filter(F.col("content_hash") == h["content_hash"]).select("path").first()
        if known:
            return known["path"]
        version = (registry.agg(F.max("version").alias("v")).first()["v"] or 0) + 1
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        version = 1
    path = f"{data_path}/snapshot_id={h['content_hash'][:16]}"
    df.write.mode("overwrite").parquet(path)
    row = [(step, version, h["content_hash"], h["rows"], created_at, label, path)]
    spark.createDataFrame(row, REGISTRY_SCHEMA).write.mode("append").parquet(registry_path)
    return path


def latest_versions(registry: DataFrame) -> DataFrame:
    rest = [c for c in registry.columns if c != "step"]
    return registry.groupBy("step").agg(F.max_by(F.struct(*rest), "version").alias("r")).select("step", "r.*")


def version_history(registry: DataFrame, step: str) -> DataFrame:
    return registry.filter(F.col("step") == step).orderBy(F.desc("version"))


def label_version(registry: DataFrame, step: str, version: int, label: str) -> DataFrame:
    hit = (F.col("step") == step) & (F.col("version") == version)
    return registry.withColumn("label", F.when(hit, label).otherwise(F.col("label")))


def fold_versions(runs: DataFrame) -> DataFrame:
    """Content-addressed versions from a run log ``(step, content_hash, created_at)``: a repeated content keeps its first version."""
    from pyspark.sql import Window

    first = runs.groupBy("step", "content_hash").agg(F.min("created_at").alias("created_at"), F.count("*").alias("runs"))
    return first.withColumn("version", F.row_number().over(Window.partitionBy("step").orderBy("created_at", "content_hash")))


# ---- upsert, export, KPI log ----
def upsert(old: DataFrame, new: DataFrame, key: str, version: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Last write per key wins; missing columns are filled with defaults. One aggregate with map-side combine."""
    both = old.unionByName(new, allowMissingColumns=True)
    for c, d in (defaults or {}).items():
        both = both.withColumn(c, F.coalesce(F.col(c), d) if c in both.columns else d)
    rest = [c for c in both.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r")).select(key, "r.*")


def markdown_lines(df: DataFrame, category: str = "category") -> DataFrame:
    """``(category, seq, value)`` lines of the readable export, a heading with the count first in each category."""
    head = df.groupBy(category).agg(F.count("*").alias("n")).select(category, F.lit(-1).cast("long").alias("seq"), F.concat(F.lit("## "), F.col(category), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("value"))
    body = df.select(category, "seq", F.concat(F.lit("### "), F.col("question"), F.lit("\n\n"), F.col("answer"), F.lit("\n\n關鍵字："), F.array_join("keywords", ", "), F.lit("\n")).alias("value"))
    return head.unionByName(body)


def export_markdown(df: DataFrame, path: str, category: str = "category") -> None:
    """Sorted text per category directory; ranges of (category, seq) keep a large category spread over many files."""
    lines = markdown_lines(df, category)
    lines.repartitionByRange(category, "seq").sortWithinPartitions(category, "seq").select(category, "value").write.mode("overwrite").partitionBy(category).text(path)


KPI_SCHEMA = "date string, report string, health_score long, alert_down long, alert_up long, core_alerts long, citations long, red_actions long, yellow_actions long, report_chars long, eeat_avg double, s9_questions long"


def append_kpis(kpis: DataFrame, path: str) -> None:
    kpis.write.mode("append").json(path)


def read_kpis(spark: SparkSession, path: str) -> DataFrame:
    """KPI log with both record shapes under one schema and both date formats as dates."""
    k = spark.read.schema(KPI_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    return k.withColumn("date", F.coalesce(F.try_to_date("date", "yyyy-MM-dd"), F.try_to_date("date", "yyyyMMdd")))
