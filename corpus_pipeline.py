"""A training corpus from documents: language, exact copies, near copies, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, whole texts; all but the last return the
columns of ``docs``. Null keys and columns, empty texts, repeated rows and empty tables behave as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidekb.llm import exactdedup, langid, mixing, ngramjoin, pieces
from tidekb.llm.common import numbered, stored, table
from tidekb.session import ship_package

def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in none of the languages: null texts, texts without a letter, and texts whose words the best language
    explains worse than all but 0.05 % of the labelled documents (letter junk, languages without labels). Each text is judged
    once, and stored with its fit."""
    plain, names = numbered(docs)
    model = langid.fit(docs)
    judged = stored(langid.identify(plain, model, names["doc_id"], names["text"]), "judged")
    kept = judged.filter((F.col("lang_pred") != "und") & (F.col("lang_fit") >= langid.usual_fit(judged, model, names["lang"])))
    return kept.select(*plain.columns).toDF(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of those with equal normalised texts."""
    return exactdedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that links of five-word Jaccard similarity 0.8 or more hold together."""
    return ngramjoin.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that each source's words meet its target; a document taken n times is n rows. Those without words go."""
    return mixing.repeat_to_targets(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document: doc_id, n_tokens, ids, round_trip."""
    return pieces.encode_texts(docs)


STAGES = [("language ID", languages), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing", mixture), ("SentencePiece", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
