"""License scan: an exact set-similarity join of text blocks with license templates, and phrase places.

A block is a window of words. A template is found in a block if at least ``threshold`` of its distinct words occur
there. Words are ordered by their frequency in the whole table, rarest first; a template can only be contained in a
block that shares one of its first words (prefix filter), is long enough (length filter) and has enough words left
after the first shared one (positional filter). What passes is verified on the whole sets.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekb.llm.common import query, table
from tidekb.session import ship_package

#: Fixed values of the contract: phrase and the label that it gives.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Templates of the method, by label: sentences by which licenses are declared. Short ones need all their words at 0.8.
TEMPLATES = {
    "mit": ["under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "apache-2": ["apache license version 2", "you may not use this file except in compliance with the license you may obtain a copy of the license at apache org licenses license 2 0"],
    "cc-by-nc": ["cc by nc", "creative commons attribution noncommercial"],
    "gpl-3": ["this work is licensed under the gnu general public license version 3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
}
#: Upper to lower case for A-Z; whatever separates words becomes a space. Bytes over 127 belong to words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8: runs of digits, letters and characters beyond ASCII, A-Z lower-cased; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def phrase_places(ws: list[bytes], phrases: list[bytes]) -> list[tuple[int, int]]:
    """(phrase number, first word) of every place where a phrase's words stand one after another, overlaps included."""
    joined, out = b" %b " % b" ".join(ws), []
    for k, p in enumerate(phrases):
        needle, at = b" %b " % p, -1
        while (at := joined.find(needle, at + 1)) >= 0:
            out.append((k, joined.count(b" ", 0, at + 1) - 1))
    return out


class TemplateIndex:
    """Prefix index of the templates under a frequency order of their words."""

    def __init__(self, templates: dict[str, list[str]], counts: dict[bytes, int], threshold: float):
        self.sets = [(label, set(words(t))) for label, texts in templates.items() for t in texts if words(t)]
        order = sorted({w for _, s in self.sets for w in s}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for _, s in self.sets]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, s) in enumerate(self.sets):
            for i, w in enumerate(sorted(s, key=self.rank.__getitem__)[: len(s) - self.need[k] + 1]):
                self.prefix.setdefault(w, []).append((k, i))
        self.heads = frozenset(self.prefix)

    def matches(self, block: set[bytes]) -> list[tuple[int, float]]:
        """(template number, containment) of every template that the block contains; ``block`` needs its template words only."""
        own, seen, out = sorted(block, key=self.rank.__getitem__), set(), []
        for j, w in enumerate(own):
            for k, i in self.prefix.get(w, ()):
                if k in seen or len(own) < self.need[k]:
                    continue
                seen.add(k)  # the first shared word: no earlier one is shared, as both sides are in one order
                members = self.sets[k][1]
                if 1 + min(len(members) - i - 1, len(own) - j - 1) >= self.need[k] and (n := len(members & block)) >= self.need[k]:
                    out.append((k, n / len(members)))
        return out

    def blocks(self, ws: list[bytes], width: int) -> list[tuple[int, int, float]]:
        """(template number, first word of the block, containment) over windows of ``width`` words, each half over the next."""
        if self.heads.isdisjoint(ws):
            return []
        step, out = max(1, width // 2), []
        last = max(0, -(-(len(ws) - width) // step))
        starts = sorted({b for i, w in enumerate(ws) if w in self.heads for b in range(max(0, (i - width) // step + 1), min(last, i // step) + 1)})
        for b in starts:
            block = {w for w in ws[b * step : b * step + width] if w in self.rank}
            out += [(k, b * step, c) for k, c in self.matches(block)]
        return out


def word_counts(docs: DataFrame, text: str, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each template word occurs in the whole table; at most one row per template word reaches the driver."""

    def count(batches):
        got: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen = Counter(words(t.as_py()))
                for w in vocabulary & seen.keys():
                    got[w] += seen[w]
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(got), pa.binary()), "n": pa.array(list(got.values()), pa.int64())})

    return {bytes(r["w"]): r["n"] for r in docs.select(text).mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}


OUT = "n_words long, places array<struct<label:string,word:long>>, blocks array<struct<label:string,word:long,containment:double>>"


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES, threshold: float = 0.8, block_words: int = 48) -> DataFrame:
    """One row per document: key, ``n_words``, ``places`` of phrases, ``blocks`` that contain a template (``word``: first word).

    Null and empty texts have no words, places or blocks. Repeated rows give repeated results; null keys pass through;
    other columns are ignored. Texts are scanned whole. Phrases and templates are parameters held by each task and
    must stay under a million characters (else ValueError).
    """
    ship_package(docs.sparkSession)
    if sum(len(t) for texts in templates.values() for t in texts) + sum(map(len, phrases)) > 1_000_000:
        raise ValueError("phrases and templates are larger than a task may hold")
    vocabulary = {w for texts in templates.values() for t in texts for w in words(t)}
    index = TemplateIndex(templates, word_counts(docs, text, vocabulary) if vocabulary else {}, threshold)
    needles, labels = [b" ".join(words(p)) for p in phrases], list(phrases.values())
    kind = docs.select(key).schema[0].dataType.simpleString()
    places_t = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    blocks_t = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("containment", pa.float64())]))

    def scan(batches):
        for b in batches:
            sizes, places, blocks = [], [], []
            for t in b.column(1):
                ws = words(t.as_py())
                sizes.append(len(ws))
                places.append([{"label": labels[k], "word": i} for k, i in phrase_places(ws, needles)])
                blocks.append([{"label": index.sets[k][0], "word": i, "containment": c} for k, i, c in index.blocks(ws, block_words)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(places, places_t), pa.array(blocks, blocks_t)], ["k", "n_words", "places", "blocks"])

    return docs.select(F.col(key).alias("k"), text).mapInArrow(scan, f"k {kind}, {OUT}").withColumnRenamed("k", key)


def _sql(width: int = 48, threshold: float = 0.8) -> str:
    """The base and the exact containment over all blocks and templates, without the filters that only save work."""
    text = lambda t: "'" + t + "'"
    rows = lambda xs: "(VALUES " + ", ".join(xs) + ")"
    phrases = rows(f"(string_split({text(p)}, ' '), {text(label)})" for p, label in PHRASES.items())
    templates = rows(f"(list_distinct(string_split({text(t)}, ' ')), {text(label)})" for label, texts in TEMPLATES.items() for t in texts)
    step = width // 2
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT r, label, unnest(list_filter(range(0, greatest(0, len(w) - len(p) + 1)::BIGINT), lambda i: w[i + 1:i + len(p)] = p)) AS i FROM d, {phrases} AS x(p, label)),
p AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS base FROM b GROUP BY r),
k AS (SELECT r, list_distinct(w[s + 1:s + {width}]) AS blk FROM (SELECT r, w, unnest(range(0, (greatest(0, ceil((len(w) - {width}) / {step})) * {step} + 1)::BIGINT, {step})) AS s FROM d)),
m AS (SELECT r, label, len(list_intersect(t, blk)) / len(t) AS c FROM k, {templates} AS x(t, label) WHERE len(list_intersect(t, blk)) >= ceil({threshold} * len(t) - 1e-9)),
t AS (SELECT r, list(DISTINCT label) AS own, max(c) AS c FROM m GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)"""


@query("op1_license_scan", _sql())
def op1_license_scan(spark, sf):
    found = scan_licenses(table(spark, sf, "documents"))
    at = lambda f: f("places.word")
    joined = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*cols))), ",")
    best = F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), at(F.array_min).alias("first_word"), at(F.array_max).alias("last_word"),
        joined("places.label").alias("base_labels"), joined("places.label", "blocks.label").alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )
