"""Table maintenance: back-fill, diff, sync, restore, filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidekb.functions.ranking import positions, with_row_number
from tidekb.functions.text import col, stable_id


def filled(c: Column | str) -> Column:
    return F.when(col(c) != "", col(c))


def latest_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Last row per key as an aggregate with map-side combine (no window over a hot key)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


# ---- back-fill ----
def backfill(df: DataFrame, external: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """Fill empty fields by precedence existing, external, rule; ``<field>_source`` names the branch that won.

    ``external`` holds one row per key; ``fields`` maps each field to its rule column.
    """
    ext = external.select(key, *[F.col(f).alias(f"_x_{f}") for f in fields])
    out = df.join(ext, key, "left")
    for f, rule in fields.items():
        old, ext_v = filled(f), filled(f"_x_{f}")
        src = F.when(old.isNotNull(), "existing").when(ext_v.isNotNull(), "external").when(rule.isNotNull(), "rule").otherwise("missing")
        out = out.withColumn(f"{f}_source", src).withColumn(f, F.coalesce(old, ext_v, rule))
    return out.drop(*[f"_x_{f}" for f in fields])


def change_log(filled_df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``(key, field, new, source)`` for every value that was filled."""
    items = F.array_compact(F.array(*[
        F.when(F.col(f"{f}_source").isin("external", "rule"),
               F.struct(F.lit(f).alias("field"), F.col(f).alias("new"), F.col(f"{f}_source").alias("source"))) for f in fields]))
    return filled_df.select(key, F.inline(items))


def missing_counts(before: DataFrame, after: DataFrame, fields: list[str]) -> DataFrame:
    cnt = lambda df, stage: df.agg(*[F.count_if(filled(f).isNull()).alias(f) for f in fields]).withColumn("stage", F.lit(stage))
    return cnt(before, "before").unionByName(cnt(after, "after"))


def model_map(rows: DataFrame, legacy: str = "legacy-pipeline") -> DataFrame:
    """Extraction model per id from artifact rows ``(id, file, pos, row_model, file_model)``: the last explicit
    model wins, ids without one get the legacy mark."""
    explicit = F.coalesce(filled("row_model"), filled("file_model"))
    order = F.when(explicit.isNotNull(), F.struct("file", "pos"))
    return rows.groupBy("id").agg(F.coalesce(F.max_by(explicit, order), F.lit(legacy)).alias("model"))


def metadata_diff(local: DataFrame, remote: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Patch rows: fields whose local value is present and differs from the remote one."""
    l = local.select(key, *[F.col(f).alias(f"_l_{f}") for f in fields])
    r = remote.select(key, *[F.col(f).alias(f"_r_{f}") for f in fields])
    diffs = [filled(f"_l_{f}").isNotNull() & ~F.col(f"_l_{f}").eqNullSafe(F.col(f"_r_{f}")) for f in fields]
    reasons = F.array_compact(F.array(*[
        F.when(d, F.concat(F.lit(f"{f}:"), F.coalesce(filled(f"_r_{f}"), F.lit("<NULL>")), F.lit("→"), F.col(f"_l_{f}"))) for f, d in zip(fields, diffs)]))
    out = l.join(r, key).select(key, *[F.when(d, F.col(f"_l_{f}")).alias(f) for f, d in zip(fields, diffs)], reasons.alias("reasons"))
    return out.filter(F.size("reasons") > 0)


def diff_summary(diff: DataFrame, fields: list[str]) -> DataFrame:
    """Patch counts per field and per target value (null value = field total)."""
    long = diff.select(F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))).filter("value IS NOT NULL")
    return long.groupBy("field", "value").agg(F.count("*").alias("n")).unionByName(
        long.groupBy("field").agg(F.count("*").alias("n")).withColumn("value", F.lit(None).cast("string")))


def merge_labels(df: DataFrame, results: DataFrame, key: str, field: str, valid: list[str], order: str) -> DataFrame:
    """Fill nulls of ``field`` from valid external labels (last per id wins); ``merge_status`` tells what happened."""
    good = results.filter(F.col(key).isNotNull() & F.col(field).isin(*valid))
    last = good.groupBy(key).agg(F.max_by(field, order).alias("_new"))
    out = df.join(last, key, "left")
    has = filled(field).isNotNull()
    status = F.when(F.col("_new").isNull(), "untouched").when(has, "already-set").otherwise("applied")
    return out.withColumn("merge_status", status).withColumn(field, F.coalesce(filled(field), F.col("_new"))).drop("_new")


def merge_counts(merged: DataFrame, results: DataFrame, key: str, field: str, valid: list[str]) -> DataFrame:
    ids = results.filter(F.col(key).isNotNull() & F.col(field).isin(*valid)).select(key).distinct()
    unmatched = ids.join(merged.select(key).distinct(), key, "left_anti").select(F.lit("no-match").alias("merge_status"))
    return merged.select("merge_status").unionByName(unmatched).groupBy("merge_status").agg(F.count("*").alias("n"))


def cut_batches(df: DataFrame, seq: str, n_batches: int) -> DataFrame:
    """Contiguous batches of ceil(n / N) rows in ``seq`` order."""
    total = df.count()
    chunk = max(1, -(-total // n_batches))
    return with_row_number(df, seq, "_rn").withColumn("batch", (F.floor((F.col("_rn") - 1) / chunk) + 1).cast("int")).drop("_rn")


# ---- curated rows against raw rows ----
def normalize_question(q: Column | str) -> Column:
    t = F.trim(F.regexp_replace(col(q), r"\s+", " "))
    return F.regexp_replace(t, "(?<=[\\u4e00-\\u9fff])\\s+(?=[\\u4e00-\\u9fff])", "")


def sync_curated(curated: DataFrame, raw: DataFrame, raw_order: str, fields: list[str]) -> DataFrame:
    """Refresh curated rows from raw rows of the same file and question: raw fields win, the curated question stays."""
    key = ["source_file", "_nq"]
    last = (
        raw.withColumn("_nq", normalize_question("question")).groupBy(*key)
        .agg(F.max_by(F.struct(*fields), raw_order).alias("_raw"))
    )
    out = curated.withColumn("_nq", normalize_question("question")).join(last, key, "left")
    status = (
        F.when(F.col("_raw").isNotNull(), "matched")
        .when(F.coalesce(filled("quality_rewritten_from_phrase"), F.lit("")) != "", "preserved-rewritten").otherwise("preserved-missing")
    )
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f"_raw.{f}"), F.col(f)))
    sid = F.coalesce(filled("stable_id"), stable_id("source_file", "question"))
    return out.withColumn("raw_sync_status", status).withColumn("stable_id", sid).drop("_raw", "_nq")


TEMPLATE_PATTERN = "^應如何處理「(.+?)」，才能兼顧 SEO 與執行效率？$"


def restore_rewritten(current: DataFrame, removed: DataFrame, rewrites: DataFrame, pattern: str = TEMPLATE_PATTERN) -> DataFrame:
    """Bring removed template rows back under a rewritten question when the new id is free; first removed row wins an id."""
    phrase = F.regexp_extract("question", pattern, 1)
    cand = removed.withColumn("phrase", phrase).filter("phrase <> ''").join(rewrites.select("phrase", "rewritten"), "phrase", "left")
    new_q = F.coalesce("rewritten", F.concat(F.lit("在 SEO 實務中，"), F.col("phrase"), F.lit(" 的正確做法是什麼？")))
    cand = cand.withColumn("question", new_q).withColumn("stable_id", stable_id("source_file", "question")).drop("rewritten")
    rest = [c for c in cand.columns if c != "stable_id"]
    first = cand.groupBy("stable_id").agg(F.min_by(F.struct(*rest), "seq").alias("r")).select("stable_id", "r.*")
    return first.join(current.select("stable_id").distinct(), "stable_id", "left_anti")


def inject_rows(existing: DataFrame, extra: DataFrame, tag: str, seq: str = "seq", name: str = "row_id") -> DataFrame:
    """Drop earlier copies of injected rows (by tag or question), append the new ones, renumber."""
    kept = existing.filter(~F.col("curation_tag").eqNullSafe(F.lit(tag))).join(extra.select("question").distinct(), "question", "left_anti")
    cols = existing.columns
    both = kept.select(*cols, F.lit(0).alias("_part")).unionByName(extra.select(*cols, F.lit(1).alias("_part")))
    top = existing.agg(F.max(seq).alias("m")).first()["m"] or 0
    both = both.withColumn("_order", F.when(F.col("_part") == 0, F.col(seq)).otherwise(F.col(seq) + top + 1))
    return with_row_number(both, "_order", name).drop("_part", "_order")


# ---- replace, add, compare ----
def replace_source(df: DataFrame, source_file: Column | str) -> DataFrame:
    """``action``: delete (unmerged row of the file), review (merged row that used it), keep."""
    f = source_file if isinstance(source_file, Column) else F.lit(source_file)
    used = F.exists("merged_from", lambda x: x == f)
    action = F.when(~F.col("is_merged") & (F.col("source_file") == f), "delete").when(F.col("is_merged") & used, "review").otherwise("keep")
    return df.withColumn("action", action)


def add_unknown(new: DataFrame, existing: DataFrame, key: str = "stable_id") -> DataFrame:
    """Rows whose id is not known yet; rows without an id always pass."""
    n = new.withColumn("_k", filled(key))
    known = existing.select(filled(key).alias("_k")).filter("_k IS NOT NULL").distinct()
    return n.join(known, "_k", "left_anti").drop("_k")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "stable_id") -> DataFrame:
    b = before.select(key).filter(filled(key).isNotNull()).distinct().withColumn("_b", F.lit(1))
    a = after.select(key).filter(filled(key).isNotNull()).distinct().withColumn("_a", F.lit(1))
    j = b.join(a, key, "full_outer")
    return j.filter("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_b").isNull(), "added").otherwise("removed").alias("change"))


def sync_diff(local: DataFrame, remote: DataFrame, key: str) -> DataFrame:
    l = local.select(key).distinct().withColumn("_l", F.lit(1))
    r = remote.select(key).distinct().withColumn("_r", F.lit(1))
    side = F.when(F.col("_r").isNull(), "local-only").when(F.col("_l").isNull(), "remote-only").otherwise("both")
    return l.join(r, key, "full_outer").select(key, side.alias("side"))


def unprocessed(sources: DataFrame, artifacts: DataFrame, key: str = "source_file", failed_mark: str = "處理失敗") -> DataFrame:
    done = artifacts.filter(F.col("qa_count").isNotNull() & ~F.contains(F.coalesce("summary", F.lit("")), F.lit(failed_mark)))
    return sources.join(done.select(key).distinct(), key, "left_anti")


def source_documents(df: DataFrame) -> DataFrame:
    """Distinct (collection, title, date) with the fields of the first row, newest first."""
    return (
        df.groupBy("source_collection", "source_title", "source_date").agg(F.min_by("source_type", "seq").alias("source_type"), F.min("seq").alias("first_seq"))
        .orderBy(F.desc_nulls_last("source_date"), "first_seq")
    )


# ---- quality ----
# fixed values: templates, placeholders and section headings that mark low quality
GENERIC_QUESTIONS = [
    r"^關於「.+?」，文章提出哪些\s*(?:值得執行的 SEO 重點|SEO 判斷與行動建議)？?$",
    r"^.+這篇研究／案例揭露了哪些關鍵 SEO 發現？?$",
    r"^關於「段落重點\s*\d+」，文章提出哪些\s*(?:值得執行的 SEO 重點|SEO 判斷與行動建議)？?$",
    r"^應如何處理「.+?」，才能兼顧 SEO 與執行效率？$",
]
GENERIC_ANSWERS = ["可先依文中提到的設定、資料比對方式或監測條件執行", r"\[How\]\s*實作上可優先採取這些做法：\s*$"]
PLACEHOLDERS = ["搭配", "有助於", "這也", "當 ", "當你"]
LOW_SIGNAL_TOPICS = ["Final thoughts", "Conclusion", "Content", "Features", "Docs", "Web Search", "AI Mode", "AI Overviews",
                     "ChatGPT ⚠️", "Google Gemini ⚠️", "Methodology and findings", "The data"]
CRITICAL_REASONS = ["generic-question-template", "generic-answer-template", "mixed-language-placeholder-heavy", "multi-block-fragmented-answer"]


def count_literal(text: Column, token: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("int")


def quality_reasons(df: DataFrame, topics: list[str] | None = None, placeholders: list[str] | None = None) -> DataFrame:
    q, a = F.trim("question"), F.trim("answer")
    topic = F.trim(F.regexp_extract(q, "^關於「(.+?)」", 1))
    marks = F.lit(0)
    for p in placeholders or PLACEHOLDERS:
        marks = marks + count_literal(a, p)
    any_of = lambda c, ps: F.array(*[c.rlike(p) for p in ps])
    hit = lambda arr: F.exists(arr, lambda x: x)
    reasons = F.array_compact(F.array(
        F.when((q == "") | (a == ""), "empty-field"),
        F.when(hit(any_of(q, GENERIC_QUESTIONS)), "generic-question-template"),
        F.when(topic.isin(*(topics or LOW_SIGNAL_TOPICS)), "low-signal-section-heading"),
        F.when(hit(any_of(a, GENERIC_ANSWERS)), "generic-answer-template"),
        F.when(marks >= 2, "mixed-language-placeholder-heavy"),
        F.when((count_literal(a, "[Evidence]") > 1) | (count_literal(a, "[How]") > 1), "multi-block-fragmented-answer"),
        F.when(F.length(a) < 80, "answer-too-short"),
    ))
    out = df.withColumn("reasons", reasons)
    return out.withColumn("keep", ~F.arrays_overlap("reasons", F.array(*[F.lit(r) for r in CRITICAL_REASONS])))


# ---- look-ups and status ----
def url_map(index: DataFrame, headers: DataFrame) -> DataFrame:
    """source_file → URL from the index table, or from document headers when the index is empty."""
    return headers.select("source_file", "url") if index.isEmpty() else index.select("source_file", "url")


def article_list(files: DataFrame, name: str = "filename", query: str | None = None) -> DataFrame:
    """Files without numbered duplicate versions, with readable titles, optionally filtered by a term."""
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    out = files.filter(~F.col(name).rlike(r"_\d{1,2}\.md$")).withColumn("title", F.trim(F.replace(stem, F.lit("_"), F.lit(" "))))
    if query:
        q = F.lit(query.lower())
        out = out.filter(F.contains(F.lower(name), q) | F.contains(F.lower("title"), q))
    return out


def freshness_updates(df: DataFrame, new_score: Column, min_diff: float = 0.001) -> DataFrame:
    """Rows whose stored freshness moved by more than ``min_diff``."""
    old = F.coalesce("freshness_score", F.lit(1.0))
    return df.withColumn("new_score", new_score).filter(F.abs(F.col("new_score") - old) > min_diff)


def freshness_batches(updates: DataFrame, key: str = "seq", size: int = 100) -> DataFrame:
    """``new_score``, ``batch``, ``ids``: updates of equal score, cut to ``size`` ids per patch in key order."""
    placed = positions(updates.select(key, "new_score"), [key], ["new_score"], "_r")
    cut = placed.withColumn("batch", F.expr(f"_r div {size}"))
    return cut.groupBy("new_score", "batch").agg(F.array_sort(F.collect_list(key)).alias("ids"))


def pipeline_status(steps: dict[str, tuple[DataFrame, DataFrame]], by: str = "source_collection") -> DataFrame:
    """Done / pending / total per collection and step from ``step → (all sources, done sources)``."""
    parts = None
    for name, (total, done) in steps.items():
        d = done.select("source_file").distinct().withColumn("_d", F.lit(1))
        part = total.join(d, "source_file", "left").groupBy(by).agg(
            F.count("_d").alias("done"), F.count_if(F.col("_d").isNull()).alias("pending"), F.count("*").alias("total")).withColumn("step", F.lit(name))
        parts = part if parts is None else parts.unionByName(part)
    return parts
