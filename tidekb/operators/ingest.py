"""From pages and documents to Q&A rows."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidekb import rules
from tidekb.functions.terms import find_terms, flag_terms
from tidekb.functions.text import col, squeeze, stable_id

NONE = "array<string>"


# ---- incremental pulls ----
def since_timestamp(spec: str, ref: Column) -> Column:
    """``7d`` counts back from ``ref``; anything else is a date or an ISO timestamp."""
    if spec.endswith("d") and spec[:-1].isdigit():
        return ref - F.expr(f"INTERVAL {int(spec[:-1])} DAYS")
    return F.lit(spec).cast("timestamp")


def changed_pages(pages: DataFrame, index: DataFrame, key: str = "page_id", edited: str = "last_edited") -> DataFrame:
    """Pages that are new or whose edit time differs from the index."""
    known = index.select(key, F.col(edited).alias("_known"), F.lit(True).alias("_seen"))
    joined = pages.join(known, key, "left")
    status = F.when(F.col("_seen").isNull(), "new").otherwise("changed")
    fresh = F.col("_seen").isNull() | ~F.col(edited).eqNullSafe(F.col("_known"))
    return joined.filter(fresh).withColumn("status", status).drop("_known", "_seen")


def high_water_mark(index: DataFrame, edited: str = "last_edited") -> DataFrame:
    return index.agg(F.max(edited).alias("since"))


def new_articles(arrivals: DataFrame, known: DataFrame, guid: str = "guid", order: str = "seq") -> DataFrame:
    """First arrival per unknown guid. ``min_by`` combines map-side, so a guid repeated a million times is cheap."""
    cols = [c for c in arrivals.columns if c != guid]
    first = arrivals.groupBy(guid).agg(F.min_by(F.struct(*cols), order).alias("r")).select(guid, "r.*")
    return first.join(known.select(guid).distinct(), guid, "left_anti")


# ---- web pages ----
# elements that are dropped with their content, then void elements that are dropped alone: fixed values
DROP_WITH_CONTENT = ["script", "style", "nav", "footer", "iframe", "object", "form", "button"]
DROP_VOID = ["embed", "input"]
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")]
MARKDOWN_STEPS = (
    [(rf"(?is)<{t}\b[^>]*>.*?</{t}\s*>", "") for t in DROP_WITH_CONTENT]
    + [(rf"(?is)<{t}\b[^>]*>", "") for t in DROP_VOID]
    + [("(?s)<!--.*?-->", ""), (r"(?is)<head\b[^>]*>.*?</head\s*>", "")]
    + [(rf"(?is)<h{n}\b[^>]*>", "\n\n" + "#" * n + " ") for n in range(1, 7)]
    + [(r"(?i)<li\b[^>]*>", "\n* "), (r"(?i)<br\b[^>]*>", "\n"), (r"(?i)</?(b|strong)>", "**"),
       (r"(?i)</?(p|div|article|section|ul|ol|table|tr|h[1-6]|blockquote)\b[^>]*>", "\n\n"), (r"(?s)<[^>]*>", "")]
)
TIDY_STEPS = [(r"[ \t\r]+\n", "\n"), (r"\n{3,}", "\n\n")]


def html_to_text(html: Column | str) -> Column:
    """Markup to clean Markdown-like text; one pass of linear regular expressions per step."""
    out = col(html)
    for pat, rep in MARKDOWN_STEPS:
        out = F.regexp_replace(out, pat, rep)
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    for pat, rep in TIDY_STEPS:
        out = F.regexp_replace(out, pat, rep)
    return F.concat(F.btrim(out, F.lit(" \n\t\r")), F.lit("\n"))


def clean_pages(pages: DataFrame, min_chars: int = 300) -> DataFrame:
    return pages.withColumn("content", html_to_text("html")).filter(F.length("content") >= min_chars).drop("html")


# ---- chunking ----
def split_chunks(df: DataFrame, text: str, max_chars: int, para_sep: str = "\n\n") -> DataFrame:
    """Greedy packing of heading sections, or of paragraphs where there are no headings; an oversize piece stays whole.

    One fold per document inside the row: no explode before packing and no shuffle. ``chunk_pos`` counts from 0.
    """
    body = F.col(text)
    sections = F.split(body, r"(?=\n##\s)")
    headed = body.rlike(r"\n##\s")
    pieces = F.when(headed, sections).otherwise(F.split(body, para_sep))
    # the separator travels in the fold's state, so it is worked out once per document and not once per piece
    start = F.struct(F.array().cast(NONE).alias("done"), F.lit("").alias("cur"), F.when(headed, "").otherwise(para_sep).alias("sep"))

    def pack(acc, piece):
        fits = (acc["cur"] == "") | (F.length(acc["cur"]) + F.length(acc["sep"]) + F.length(piece) <= max_chars)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))).alias("done"),
            F.when(acc["cur"] == "", piece).when(fits, F.concat(acc["cur"], acc["sep"], piece)).otherwise(piece).alias("cur"),
            acc["sep"].alias("sep"))

    def finish(acc):
        return F.when(acc["cur"] != "", F.concat(acc["done"], F.array(acc["cur"]))).when(F.size(acc["done"]) > 0, acc["done"]).otherwise(F.array(body))

    chunks = F.aggregate(pieces, start, pack, finish)
    return df.select(*[c for c in df.columns if c != text], F.posexplode(chunks).alias("chunk_pos", "chunk"))


# ---- rule-based extraction ----
def clean_excerpt(text: Column, max_len: int = rules.EXCERPT_CHARS) -> Column:
    t = F.btrim(F.regexp_replace(text, r"\s+", " "), F.lit(" -*#\t"))
    return F.when(F.length(t) <= max_len, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, max_len - 1)), F.lit("…")))


def all_markers() -> list[str]:
    return [m.lower() for ms in rules.CATEGORY_MARKERS.values() for m in ms]


def local_segments(text: Column | str, markers: list[str] | None = None) -> Column:
    """Up to three distinct marker-bearing paragraphs, else up to two longer plain ones."""
    blocks = F.transform(F.split(col(text), r"\n\s*\n"), lambda b: clean_excerpt(b))
    skip = F.transform(blocks, lambda b: F.lower(b))
    boiler, marked = flag_terms(skip, rules.BOILERPLATE_MARKERS), flag_terms(skip, markers or all_markers())
    z = F.arrays_zip(blocks.alias("b"), boiler.alias("x"), marked.alias("m"))
    clean = F.filter(z, lambda r: ~r["x"])
    bearing = F.filter(clean, lambda r: (F.length(r["b"]) >= rules.SEGMENT_MIN_CHARS) & r["m"])
    plain = F.filter(clean, lambda r: F.length(r["b"]) >= rules.FALLBACK_MIN_CHARS)
    text_of = lambda arr: F.transform(arr, lambda r: r["b"])
    return F.when(F.size(bearing) > 0, F.slice(F.array_distinct(text_of(bearing)), 1, 3)).otherwise(F.slice(text_of(plain), 1, 2))


def derive_keywords(title: Column | str, text: Column | str, markers: list[str] | None = None,
                    head_chars: int | None = None, limit: int = 6) -> Column:
    """Markers found in title and text, in table order, then title words; distinct, at most ``limit``."""
    raw = list(dict.fromkeys(markers or list(chain.from_iterable(rules.CATEGORY_MARKERS.values()))))
    body = col(text) if head_chars is None else F.substring(col(text), 1, head_chars)
    src = F.lower(F.concat(col(title), F.lit("\n"), body))
    found = find_terms(src, [m.lower() for m in raw])
    if any(m != m.lower() for m in raw):
        spelled = F.create_map(*[F.lit(x) for m in raw for x in (m.lower(), m)])
        found = F.transform(found, lambda t: spelled[t])
    words = F.regexp_extract_all(col(title), F.lit(r"[A-Za-z][A-Za-z0-9\-]{2,}|[一-鿿]{2,}"), F.lit(0))
    return F.slice(F.array_distinct(F.concat(found, words)), 1, limit)


def extract_qa(docs: DataFrame, title: str = "title", text: str = "text", source_file: str = "source_file",
               date: str | None = None, markers: list[str] | None = None, head_chars: int | None = None) -> DataFrame:
    """Documents to template Q&A rows: one row per segment with question, answer, keywords, confidence and id.

    A document with keywords but no segment yields one row from its cleaned text.
    """
    base = docs.withColumn("_kw", derive_keywords(title, text, markers, head_chars)).withColumn("_seg", local_segments(text, markers))
    base = base.filter((F.size("_kw") > 0) | (F.size("_seg") > 0))
    whole = F.array(clean_excerpt(F.col(text), 260))
    segs = F.when(F.size("_seg") > 0, F.col("_seg")).otherwise(whole)
    rows = base.select(*docs.columns, "_kw", F.posexplode(segs).alias("pos", "segment"))
    name = F.when(F.col(title) != "", F.col(title)).otherwise("這份內容")
    lead = F.when(F.size("_kw") > 0, F.get("_kw", F.least(F.col("pos"), F.size("_kw") - 1))).otherwise("SEO")
    when = F.lit("") if date is None else F.when(F.coalesce(F.col(date), F.lit("")) != "", F.concat(F.lit(" "), F.col(date))).otherwise("")
    question = F.concat(name, F.lit(" 提到的「"), lead, F.lit("」重點是什麼，後續應如何處理？"))
    answer = F.concat(
        F.lit("[What] "), F.col("segment"),
        F.lit(" [Why] 這表示該議題已被視為會影響搜尋可見度、索引訊號或內容策略的重點。 "
              "[How] 建議先把會議中提到的頁面、指標或設定列入排查清單，並用 Search Console、站內檢查或內容調整逐項驗證。 [Evidence] 依據"),
        when, F.lit("內容原文可整理出上述重點。"))
    return (
        rows.withColumn("question", question).withColumn("answer", answer)
        .withColumn("keywords", F.when(F.size("_kw") > 0, F.col("_kw")).otherwise(F.array(lead)))
        .withColumn("confidence", F.lit(rules.EXTRACTION_CONFIDENCE))
        .withColumn("stable_id", stable_id(source_file, "question")).drop("_kw", "segment")
    )


def intro_paragraphs(text: Column | str, limit: int = 3) -> Column:
    """First plain paragraphs after the header rule, stopping at a table of contents."""
    t = col(text)
    cut = F.instr(t, "---\n")
    body = F.when(cut > 0, F.substring(t, cut + 4, F.length(t))).otherwise(t)
    blocks = F.transform(F.split(body, "\n\n"), lambda b: F.btrim(b, F.lit(" \n\t\r")))
    stop = F.array_position(blocks, "Contents")
    blocks = F.when(stop > 0, F.slice(blocks, F.lit(1), (stop - 1).cast("int"))).otherwise(blocks)
    plain = F.filter(blocks, lambda b: (b != "") & ~b.startswith("#") & ~b.startswith("!") & ~b.startswith("```"))
    return F.slice(F.transform(plain, squeeze), 1, limit)


def key_takeaways(text: Column | str, limit: int = 4) -> Column:
    """Bullets between the takeaways heading and the next heading."""
    lines = F.transform(F.split(col(text), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    at = F.array_position(F.transform(lines, F.lower), "## key takeaways").cast("int")
    after = F.slice(lines, at + 1, F.size(lines))
    end = F.array_position(F.transform(after, lambda x: x.startswith("##").cast("int")), 1).cast("int")
    block = F.when(end > 0, F.slice(after, F.lit(1), end - 1)).otherwise(after)
    bullets = F.transform(F.filter(block, lambda x: x.startswith("*")), lambda x: F.regexp_replace(F.ltrim(x, F.lit("* ")), r"\s+", " "))
    return F.when(at > 0, F.slice(bullets, 1, limit)).otherwise(F.array().cast(NONE))
