"""Metric and segment sheets as tab-separated texts, one row per (sheet, metric) out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidekb import rules
from tidekb.operators.metrics import parse_cell

DATE_CELL = r"^\d+/\d+/\d+"


def _lines(text: str) -> Column:
    """Non-blank lines of a sheet, in order."""
    return F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(x) != "")


def _cell(cols: str, i: int) -> Column:
    return F.get(F.col(cols), F.lit(i))


def _trend(cols: str, i: int) -> Column:
    raw = F.trim(_cell(cols, i))
    return F.when(raw.endswith("%"), parse_cell(raw))


def _table(sheets: DataFrame, text: str) -> DataFrame:
    """``(…, header ARRAY, cols ARRAY)`` per data line. A sheet is a few hundred lines, split inside its row."""
    marked = lambda x: F.contains(x, F.lit(rules.SHEET_HEADER_MARKS[0])) | F.contains(x, F.lit(rules.SHEET_HEADER_MARKS[1]))
    s = sheets.withColumn("_l", _lines(text))
    s = s.withColumn("_h", F.array_position(F.transform("_l", lambda x: marked(x).cast("int")), 1).cast("int"))
    s = s.withColumn("_h", F.greatest(F.col("_h"), F.lit(1))).withColumn("header", F.split(F.get("_l", F.col("_h") - 1), "\t"))
    body = F.slice("_l", F.col("_h") + 1, F.greatest(F.size("_l"), F.lit(1)))
    keep = [c for c in sheets.columns if c != text]
    rows = s.select(*keep, "header", F.posexplode(body).alias("line_no", "line")).withColumn("cols", F.split("line", "\t"))
    return rows.withColumn("name", F.trim(F.get("cols", F.lit(0)))).filter(~F.col("name").isin(*rules.SKIP_METRICS)).drop("line")


def parse_metric_sheets(sheets: DataFrame, text: str = "text", percent_trends_only: bool = True) -> DataFrame:
    """Monthly, weekly, max, min, latest and previous value of every metric; a repeated name keeps its last line."""
    t = _table(sheets, text)
    dates = F.filter(F.transform("header", lambda c: F.trim(c)), lambda c: c.rlike(DATE_CELL))
    trend = _trend if percent_trends_only else (lambda c, i: parse_cell(_cell(c, i)))
    keys = [c for c in sheets.columns if c != text]
    row = t.select(
        *keys, "name", "line_no", trend("cols", 1).alias("monthly"), trend("cols", 2).alias("weekly"), parse_cell(_cell("cols", 3)).alias("max"), parse_cell(_cell("cols", 4)).alias("min"),
        parse_cell(_cell("cols", 6)).alias("latest"), parse_cell(_cell("cols", 7)).alias("previous"),
        F.coalesce(F.get(dates, F.lit(0)), F.lit("")).alias("latest_date"), F.coalesce(F.get(dates, F.lit(1)), F.lit("")).alias("previous_date"))
    rest = [c for c in row.columns if c not in (*keys, "name", "line_no")]
    return row.groupBy(*keys, "name").agg(F.max_by(F.struct(*rest), "line_no").alias("r")).select(*keys, "name", "r.*")


def metric_history(sheets: DataFrame, weeks: int, text: str = "text") -> DataFrame:
    """Long series ``(…, name, week_idx, date, value)`` from the first ``weeks`` date columns."""
    t = _table(sheets, text)
    keys = [c for c in sheets.columns if c != text]
    cells = F.slice(F.filter(F.arrays_zip(F.transform("header", lambda c: F.trim(c)).alias("d"), F.col("cols").alias("v")), lambda z: z["d"].rlike(DATE_CELL)), 1, weeks)
    long = t.select(*keys, "name", F.posexplode(cells).alias("week_idx", "z"))
    return long.select(*keys, "name", "week_idx", F.col("z.d").alias("date"), parse_cell(F.col("z.v")).alias("value"))


# fixed values: labels of segment sheets
SEGMENT_HEADER_WORDS = ["變化", "趨勢", "差異", "總頁", "頁數", "基準", "Sparklines"]


def _row_type(s: Column) -> Column:
    return (
        F.when(s == "全網域", "domain").when(F.contains(s, F.lit("檢索未索引")), "not_indexed_total").when(s == "總合", "sum")
        .when(s.startswith("總合/"), "ratio").when(s == "差距", "gap").when(s.startswith("/"), "path")
    )


def parse_segment_sheets(sheets: DataFrame, text: str = "text") -> DataFrame:
    """Typed rows of the indexing section of every sheet.

    The section runs from the domain line (at most three lines above the last anchor line) to the gap line; a
    sheet without an anchor is all section.
    """
    keys = [c for c in sheets.columns if c != text]
    first = lambda x: F.trim(F.get(F.split(x, "\t"), F.lit(0)))
    is_header = lambda x: F.exists(F.split(F.lit("\x01".join(SEGMENT_HEADER_WORDS)), "\x01"), lambda w: F.contains(x, w))
    s = sheets.withColumn("_all", _lines(text))
    head = F.array_position(F.transform("_all", lambda x: is_header(x).cast("int")), 1).cast("int")
    s = s.withColumn("_l", F.slice("_all", head + 1, F.greatest(F.size("_all"), F.lit(1)))).withColumn("_n", F.size("_l"))
    s = s.withColumn("_c", F.transform("_l", first))
    last_true = lambda flags: F.coalesce(F.array_max(F.transform(F.filter(F.transform(flags, lambda f, i: F.when(f, i + 1)), lambda p: p.isNotNull()), lambda p: p)), F.lit(0))
    s = s.withColumn("_a", last_true(F.transform("_c", lambda c: F.contains(c, F.lit("檢索未索引")) & F.contains(c, F.lit("全部")))))
    s = s.withColumn("_d", last_true(F.transform("_c", lambda c, i: (c == "全網域") & (i + 1 < F.col("_a")) & (i + 1 >= F.col("_a") - 3))))
    gaps = F.filter(F.transform("_c", lambda c, i: F.when((c == "差距") & (i + 1 > F.col("_a")), i + 1)), lambda p: p.isNotNull())
    start = F.when(F.col("_a") == 0, 1).when(F.col("_d") > 0, F.col("_d")).otherwise(F.col("_a"))
    end = F.when(F.col("_a") == 0, F.col("_n")).otherwise(F.coalesce(F.array_min(gaps), F.col("_n")))
    rows = s.select(*keys, F.posexplode(F.slice("_l", start, F.greatest(end - start + 1, F.lit(0)))).alias("line_no", "line")).withColumn("cols", F.split("line", "\t"))
    seg = F.trim(_cell("cols", 0))
    out = rows.withColumn("segment", seg).withColumn("row_type", _row_type(seg)).filter("row_type IS NOT NULL")
    num = {"change_pct": 1, "delta": 2, "value_a": 3, "value_b": 4, "baseline": 6}
    return out.select(*keys, "line_no", "segment", "row_type", *[parse_cell(_cell("cols", i)).alias(n) for n, i in num.items()])
