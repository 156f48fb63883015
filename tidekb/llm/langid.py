"""Language identification by word-first backoff.

A word that the training sample holds is scored by its log frequency in each language. A word that it doesn't hold is
scored by character n-grams: at each place the longest known n-gram, from five characters down to one. A document's
language is the one with the greatest sum over its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidekb.llm.common import crc_mod, kept, query, stored, table
from tidekb.session import ship_package

WORD = re.compile(r"[^\W\d_]+")
LONGEST = 5
#: What a place of an unknown word loses for each step down to a shorter n-gram, in natural logarithms.
STEP = 0.4
#: Allowance in the fit of a text of one word; it falls with the root of the number of words.
SHORT = 2.0
#: What a word counts in the fit if even its single characters are unknown.
BLANK = -15.0
#: By how much a text may be explained worse than nearly all of the labelled sample.
MARGIN = 0.25
NEW = ["lang_pred", "lang_score", "lang_fit"]


def words(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return WORD.findall((text or "").lower())


def grams(word: str) -> list[str]:
    """Character n-grams of the word with its ends marked, of every length up to the longest."""
    w = f"<{word}>"
    return [w[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(w) - n + 1)]


def _count(docs: DataFrame, lang: str, text: str, cut) -> DataFrame:
    def count(batches):
        for b in (b.slice(at, 1000) for b in batches for at in range(0, b.num_rows, 1000)):
            got: dict[str, Counter] = {}
            for la, t in zip(b.column(0), b.column(1)):
                got.setdefault(la.as_py(), Counter()).update(words(t.as_py()))
            for la, c in got.items():
                if cut:
                    pieces: Counter = Counter()
                    for w, n in c.items():
                        for g in grams(w):
                            pieces[g] += n
                    c = pieces
                yield pa.RecordBatch.from_arrays([pa.array([la] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "item", "n"])

    counted = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, item string, n long")
    return counted.groupBy("lang", "item").agg(F.sum("n").alias("n"))


def _shares(sizes: list[int], most: int) -> list[int]:
    """How much of each size is taken so that the sum is at most ``most``: equal parts, and what small ones leave goes to the larger."""
    out, left = [0] * len(sizes), most
    for k, i in enumerate(sorted(range(len(sizes)), key=sizes.__getitem__)):
        out[i] = min(sizes[i], left // (len(sizes) - k))
        left -= out[i]
    return out


def _sample(labelled: DataFrame, lang: str, text: str, key: str, max_docs: int, least: int = 20) -> DataFrame:
    """About ``max_docs`` rows by hash of key and text, as many of each language; languages with fewer rows whole, and about ``least`` rows of each at least."""
    sizes = {r[0]: r["n"] for r in labelled.groupBy(F.col(lang)).agg(F.count("*").alias("n")).collect()}
    parts = 1 << 20
    takes = zip(sizes, _shares(list(sizes.values()), max_docs))
    limits = {la: math.ceil(parts * max(n, least) / sizes[la]) for la, n in takes if max(n, least) < sizes[la]}
    if not limits:
        return labelled
    limit = F.element_at(F.create_map(*[F.lit(x) for pair in limits.items() for x in pair]), F.col(lang))
    return labelled.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key), F.col(text)), F.lit(parts)) < F.coalesce(limit, F.lit(parts)))


def _frequent(counts: DataFrame, langs: list[str], most: int) -> tuple[list[str], np.ndarray]:
    """At most ``most`` items that occur twice at least, and their counts by language.

    Each language has an equal part of ``most`` (more, where others have fewer items) and picks all items whose count in it reaches the lowest bound that admits no more.
    """
    by = [F.sum(F.when(F.col("lang") == la, F.col("n")).otherwise(0)).alias(f"n{i}") for i, la in enumerate(langs)]
    wide = counts.groupBy("item").agg(F.sum("n").alias("n"), *by).filter("n > 1")
    level = [F.when(F.col(f"n{i}") > 0, F.floor(F.log2(f"n{i}") * 64)) for i in range(len(langs))]
    found: list[list[tuple[int, int]]] = [[] for _ in langs]
    if langs:
        own = wide.select(F.posexplode(F.array(*level)).alias("i", "level")).filter("level IS NOT NULL")
        for r in own.groupBy("i", "level").agg(F.count("*").alias("k")).collect():
            found[r["i"]].append((r["level"], r["k"]))
    picked = F.lit(False)
    for i, room in enumerate(_shares([sum(k for _, k in x) for x in found], most)):
        bound, got = None, 0
        for lv, k in sorted(found[i], reverse=True):
            if got + k > room:
                break
            bound, got = lv, got + k
        if bound is not None:
            picked = picked | F.coalesce(level[i] >= bound, F.lit(False))
    rows = wide.filter(picked).toArrow()  # columns, not row objects: at most ``most`` short strings and numbers
    items = rows.column("item").to_pylist()
    if not items:
        return [], np.zeros((0, len(langs)))
    order = sorted(range(len(items)), key=items.__getitem__)
    return [items[i] for i in order], np.stack([rows.column(f"n{i}").to_numpy() for i in range(len(langs))], 1)[order].astype(float)


class Backoff:
    """The fitted model: log frequencies per language of words and n-grams."""

    def __init__(self, langs: list[str], words: list[str], word_counts: np.ndarray, word_totals: np.ndarray, grams: list[str], gram_counts: np.ndarray, gram_totals: np.ndarray):
        self.langs = langs

        def logs(keys, counts, totals):
            return dict(zip(keys, range(len(keys)))), np.log((counts + 0.1) / (totals + 0.1 * (len(keys) + 1))).astype(np.float32).reshape(len(keys), len(langs))

        self.word_at, self.word_log = logs(words, word_counts, word_totals)
        self.gram_at, self.gram_log = logs(grams, gram_counts, gram_totals)

    def places(self, word: str) -> tuple[list[int], int]:
        """Of an unknown word: the longest known n-gram at each place, and the characters by which they fall short in all."""
        w, at, rows, lost = f"<{word}>", self.gram_at.get, [], 0
        for i in range(max(1, len(w) - 1)):
            for n in range(min(LONGEST, len(w) - i), 0, -1):
                k = at(w[i : i + n])
                if k is not None:
                    rows.append(k)
                    lost += LONGEST - n
                    break
        return rows, lost

    def backed_off(self, words: list[str]) -> np.ndarray:
        """Per word and language: the mean log frequency at its places, less a step per missing character; 0 if no place is known."""
        found = [self.places(w) for w in words]
        rows = np.array([k for r, _ in found for k in r], np.int64)
        size, lost = np.array([len(r) for r, _ in found]), np.array([x for _, x in found])
        ends = np.concatenate([[0], np.cumsum(size)])
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.gram_log[rows], 0, dtype=np.float64)])
        return (sums[ends[1:]] - sums[ends[:-1]] - STEP * lost[:, None]) / np.maximum(1, size)[:, None]


class Scorer(dict):
    """word -> row of ``table``; unseen words get a row when first met. Both are bounded: when full, unseen words are forgotten."""

    def __init__(self, model: Backoff, room: int = 120_000):
        self.model, self.base = model, len(model.word_at)
        self.table = np.zeros((self.base + room, len(model.langs)), np.float32)
        self.table[: self.base] = model.word_log
        super().__init__(model.word_at)
        self.waiting: list[str] = []
        self.used = self.base

    def __missing__(self, word: str) -> int:
        self[word] = k = self.used + len(self.waiting)
        self.waiting.append(word)
        return k

    def rows(self, words: list[str]) -> np.ndarray:
        """Rows of at most as many words as there is room; words met for the first time are scored together."""
        if self.used + len(words) > len(self.table):
            self.clear()
            self.update(self.model.word_at)
            self.used = self.base
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.waiting:
            self.table[self.used : self.used + len(self.waiting)] = self.model.backed_off(self.waiting)
            self.used += len(self.waiting)
            self.waiting = []
        return self.table[at]

    def predict(self, texts: list[str | None], at_once: int = 50_000) -> list[tuple[str, float]]:
        """(language, share of the likelihood) of each text."""
        return [x[:2] for x in self.judged(texts, at_once)]

    def judged(self, texts: list[str | None], at_once: int = 50_000) -> list[tuple[str, float, float | None]]:
        """(language, share of the likelihood, fit) of each text; long texts are summed part by part."""
        langs = self.model.langs
        split = [words(t) if langs else [] for t in texts]
        total, blank = np.zeros((len(texts), len(langs))), np.zeros(len(texts))
        for owner, part in _parts(split, at_once):
            got = self.rows(part)
            blank += np.bincount(owner, weights=~got.any(1), minlength=len(texts))
            for k in range(len(langs)):
                total[:, k] += np.bincount(owner, weights=got[:, k], minlength=len(texts))
        best = total.argmax(1) if langs else []
        out: list[tuple[str, float, float | None]] = []
        for i, ws in enumerate(split):
            if not ws:
                out.append(("und", 0.0, None))
                continue
            top = total[i][best[i]]
            out.append((langs[best[i]], float(1 / np.exp(total[i] - top).sum()), float((top + BLANK * blank[i]) / len(ws) + SHORT / math.sqrt(len(ws)))))
        return out


def _parts(split: list[list[str]], at_once: int):
    """(number of the text per word, words), at most so many words at once, texts in order."""
    owner: list[np.ndarray] = []
    held: list[str] = []
    for i, ws in enumerate(split):
        for at in range(0, len(ws), at_once):
            part = ws[at : at + at_once]
            if len(held) + len(part) > at_once:
                yield np.concatenate(owner), held
                owner, held = [], []
            owner.append(np.full(len(part), i))
            held += part
    if held:
        yield np.concatenate(owner), held


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", train: Column | None = None, max_docs: int = 8_000, max_words: int = 150_000, max_grams: int = 150_000) -> Backoff:
    """Fit on the labelled rows that ``train`` selects.

    ``max_docs`` bounds the sample of labelled rows: about that many by hash of key and text, so that reruns agree, in equal
    parts by language. Rarer languages are taken whole; past 400 languages the sample grows by about 20 rows for each. The texts are
    used whole. ``max_words`` and ``max_grams`` bound the model, which is sent to every task: each language's most frequent
    ones, of those that occur twice at least over all. No labelled row gives a model that knows no language.
    """
    ship_package(docs.sparkSession)
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if train is not None:
        labelled = labelled.filter(train)
    sample = _sample(labelled, lang, text, key, max_docs)
    fitted = []
    langs: list[str] = []
    for cut, most in ((False, max_words), (True, max_grams)):
        counts = stored(_count(sample, lang, text, cut), "counts")
        totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
        langs = langs or sorted(totals)
        fitted += [*_frequent(counts, langs, most), np.array([totals.get(la, 0) for la in langs], float)]
    return Backoff(langs, *fitted)


def identify(docs: DataFrame, model: Backoff, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` (all columns) with ``lang_pred``; ``lang_score``, the share of the winner's likelihood among the languages;
    and ``lang_fit``, how well the winner explains the text: the mean log likelihood of its words, plus 2 / sqrt(words) as
    allowance for short texts (compare it with ``usual_fit``).

    Null texts and texts without a letter are ``und`` with score 0 and no fit, as are all under a model without languages.
    Very long texts are summed part by part. Equal likelihoods go to the first language by code point. Columns named
    like the new ones are replaced.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)  # at most max_words + max_grams rows
    docs = docs.drop(*NEW)
    place = docs.columns.index(text)
    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add("lang_pred", StringType()).add("lang_score", DoubleType()).add("lang_fit", DoubleType())
    token = f"{spark.sparkContext.applicationId}-{id(shared)}"

    def predict(batches):
        scorer = kept(token, lambda: Scorer(shared.value))
        for b in batches:
            got = [x for at in range(0, b.num_rows, 500) for x in scorer.judged(b.column(place).slice(at, 500).to_pylist())]
            new = [pa.array([g[0] for g in got], pa.string()), *(pa.array([g[k] for g in got], pa.float64()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *NEW])

    return docs.mapInArrow(predict, schema)


def usual_fit(docs: DataFrame, model: Backoff | None, lang: str = "lang", text: str = "text", key: str = "doc_id", share: float = 0.0005) -> float:
    """``MARGIN`` below the ``lang_fit`` that all but ``share`` of the labelled rows reach; all of them count.

    ``docs`` that ``identify`` has judged aren't judged again. Texts below it are in none of the languages. Without labelled
    rows nothing is below it.
    """
    labelled = docs.filter(F.col(lang).isNotNull())
    judged = labelled if "lang_fit" in docs.columns else identify(labelled.select(key, text), model, key, text)
    fit = judged.agg(F.percentile_approx("lang_fit", share, 100_000).alias("fit")).first()["fit"]
    return -math.inf if fit is None else fit - MARGIN


@query("op6_language_id")
def op6_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    model = fit(docs, train=crc_mod("doc_id", 5) != 0)
    held_out = (crc_mod("doc_id", 5) == 0).alias("held_out")
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", F.col("lang_score").alias("score"))
