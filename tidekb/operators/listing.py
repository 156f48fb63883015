"""Filtered lists, counts and look-ups over the Q&A table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALAR_FILTERS = ["category", "primary_category", "difficulty", "serving_tier"]
ARRAY_FILTERS = {"intent_label": "intent_labels", "scenario_tag": "scenario_tags", "evidence_scope": "evidence_scope"}
EXACT_FILTERS = ["source_type", "source_collection", "extraction_model", "maturity_relevance"]


def filter_rows(df: DataFrame, **params) -> DataFrame:
    """All optional predicates of the list call; comma lists mean any of. Everything is one pushed-down filter."""
    out = df
    for p, v in params.items():
        if v is None or v == "":
            continue
        if p in SCALAR_FILTERS:
            c = F.col(p) if p in df.columns else F.col("category")
            if p == "primary_category" and p in df.columns:
                c = F.coalesce(p, "category")
            if p == "serving_tier":
                c = F.coalesce(c, F.lit("canonical"))
            out = out.filter(c.isin(*v.split(",")))
        elif p in ARRAY_FILTERS:
            out = out.filter(F.arrays_overlap(ARRAY_FILTERS[p], F.array(*[F.lit(x) for x in v.split(",")])))
        elif p in EXACT_FILTERS:
            out = out.filter(F.col(p) == v)
        elif p == "evergreen":
            out = out.filter(F.col(p) == F.lit(v))
        elif p == "keyword":
            k = F.lit(v.lower())
            out = out.filter(F.contains(F.lower("question"), k) | F.contains(F.lower("answer"), k) | F.exists("keywords", lambda x: F.contains(F.lower(x), k)))
        else:
            raise ValueError(f"unknown filter {p}")
    return out


def page(df: DataFrame, sort_by: str | None = None, descending: bool = True, limit: int = 20, offset: int = 0, seq: str = "seq") -> DataFrame:
    """One page in a total order (sort key, then row order): a top-k over offset + limit rows, not a full sort."""
    order = [F.col(seq).asc()]
    if sort_by:
        order.insert(0, F.col(sort_by).desc() if descending else F.col(sort_by).asc())
    return df.orderBy(*order).offset(offset).limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def categories(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def collections(df: DataFrame) -> DataFrame:
    """Collections by size with the type of their last row."""
    return df.groupBy("source_collection").agg(F.max_by("source_type", "seq").alias("source_type"), F.count("*").alias("n")).orderBy(F.desc("n"), "source_collection")


def lookup(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")
