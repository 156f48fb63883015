"""Document and artifact sources (A1-A4, A10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidekb.functions.text import col, stable_id

KB_SCHEMA = T.StructType([
    T.StructField("stable_id", T.StringType()), T.StructField("question", T.StringType()), T.StructField("answer", T.StringType()),
    T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("confidence", T.DoubleType()), T.StructField("category", T.StringType()),
    T.StructField("source_file", T.StringType()), T.StructField("source_title", T.StringType()), T.StructField("source_date", T.StringType()),
    T.StructField("source_type", T.StringType()), T.StructField("source_collection", T.StringType()), T.StructField("extraction_model", T.StringType()),
])


def read_markdown(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``(path, text)`` of whole Markdown files under the given directories."""
    return spark.read.text(paths, wholetext=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def attach_collection(files: DataFrame, dir_map: dict[str, tuple[str, str]]) -> DataFrame:
    """Directory name to (source_type, source_collection); an unknown directory is an article collection of its own name."""
    d = F.element_at(F.split("path", "/"), -2)
    kind, coll = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name, (t, c) in dir_map.items():
        kind, coll = kind.when(d == name, t), coll.when(d == name, c)
    return files.withColumns({"source_file": F.element_at(F.split("path", "/"), -1), "source_type": kind.otherwise("article"), "source_collection": coll.otherwise(d)})


def _field(text: str, label: str) -> Column:
    got = F.trim(F.regexp_extract(text, rf"(?m)^- \*\*{label}\*\*[:：][ \t]*(.*)$", 1))
    return F.when(got != "", got)


def parse_header(files: DataFrame, text: str = "text", name: str = "source_file") -> DataFrame:
    """Header columns of a Markdown document; the date falls back from the body to the title and the file name."""
    t = F.trim(F.regexp_extract(text, r"(?m)^# (.+)$", 1))
    title = F.when(t != "", t)
    body_date = F.regexp_extract(F.coalesce(_field(text, "發佈日期"), F.lit("")), r"(\d{4}-\d{2}-\d{2})", 1)
    title_date = F.regexp_extract(F.coalesce(title, F.lit("")), r"(\d{4})[-/.]?(\d{2})[-/.]?(\d{2})", 0)
    name_date = F.regexp_extract(col(name), r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})", 0)
    dashed = lambda c: F.regexp_replace(F.regexp_replace(c, r"[^0-9]", ""), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    pick = F.coalesce(*[F.when(c != "", c) for c in (body_date, dashed(title_date), dashed(name_date))])
    return files.withColumns({
        "source_title": F.coalesce(title, F.regexp_replace(col(name), r"\.md$", "")), "source_date": pick, "source_url": _field(text, "來源 URL"),
        "header_type": _field(text, "來源類型"), "header_collection": _field(text, "來源集合")})


def read_knowledge_base(spark: SparkSession, enriched: str, final: str, enriched_exists: bool) -> DataFrame:
    """Rows of the knowledge-base file: the enriched file where there is one, else the final file."""
    wrapper = T.StructType([T.StructField("qa_database", T.ArrayType(KB_SCHEMA))])
    path = enriched if enriched_exists else final
    return spark.read.schema(wrapper).json(path, multiLine=True).select(F.inline("qa_database"))


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON-lines log; lines that do not parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


ARTIFACT_SCHEMA = "meeting_summary string, extraction_model string, qa_pairs array<struct<question:string, answer:string, keywords:array<string>, confidence:double, source_file:string>>"


def union_artifacts(files: DataFrame, failed_mark: str = "處理失敗") -> DataFrame:
    """Q&A rows of per-source artifact files ``(file, payload)``; broken and failed ones are skipped, a missing
    source file is inferred from the artifact's name."""
    p = files.withColumn("_p", F.from_json("payload", ARTIFACT_SCHEMA))
    ok = p.filter(F.col("_p.qa_pairs").isNotNull() & ~F.contains(F.coalesce("_p.meeting_summary", F.lit("")), F.lit(failed_mark)))
    rows = ok.select("file", F.col("_p.extraction_model").alias("extraction_model"), F.posexplode("_p.qa_pairs").alias("pos", "qa"))
    inferred = F.regexp_replace("file", r"_qa\.json$", ".md")
    out = rows.select("file", "pos", "extraction_model", "qa.question", "qa.answer", "qa.keywords", "qa.confidence", F.coalesce(F.when(F.col("qa.source_file") != "", F.col("qa.source_file")), inferred).alias("source_file"))
    return out.withColumn("stable_id", stable_id("source_file", "question"))


def artifact_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(F.count("*").alias("qa_count"), F.bround(F.avg("confidence"), 4).alias("avg_confidence"))
