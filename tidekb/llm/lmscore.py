"""Language-model scoring of whole documents: a recurrent model trained across the cluster, and a unigram base.

Token counts cover every token of all training documents. The recurrent model knows the most frequent tokens; any
other is the unknown one, times its share among the counts of those others. It is trained by rounds: each task starts
from the common parameters, trains on its part of the round's documents, and Spark averages what the tasks found,
weighted by tokens. Over the rounds every training document is learnt from once. Counts of rare tokens reach the documents by a join, those of frequent ones (a table
of bounded size) with the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidekb.functions.blas import one_thread
from tidekb.llm.common import crc_mod, query, stored, table
from tidekb.llm.gru import END, UNKNOWN, Gru, score, train
from tidekb.session import ship_package

#: The end token in count tables; no other token can hold a line feed.
END_TOKEN = b"\n"
#: Parameter averages are summed as integers of this scale, so that reruns agree whatever the order.
SCALE = 1 << 32


def tokens(text: str | bytes | None) -> list[bytes]:
    """Blank-separated words, A-Z lower-cased, without the end token."""
    if isinstance(text, str):
        text = text.encode("utf-8", "surrogatepass")
    return (text or b"").lower().split()


@dataclass
class LanguageModel:
    counts: DataFrame  # (token, n) of all training tokens
    total: int
    distinct: int
    ends: int
    head: dict[bytes, int]  # frequent token -> count, most frequent first
    words: dict[bytes, int]  # tokens of the recurrent model -> id
    shape: tuple[int, int, int, int]
    weights: np.ndarray

    @property
    def others(self) -> int:
        """Denominator of a token's share among those that the recurrent model doesn't know."""
        return self.total - self.ends - sum(self.head[w] for w in self.words) + self.distinct - (self.ends > 0) - len(self.words) + 1


def count_tokens(docs: DataFrame, text: str, room: int = 300_000) -> DataFrame:
    """(token, n) over whole texts, one end token per document; a task holds at most ``room`` tokens before it passes them on."""

    def count(batches):
        got: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.int64())], ["token", "n"])

        for b in batches:
            for t in b.column(0):
                got.update(tokens(t.as_py()))
                if len(got) > room:
                    yield flush()
                    got.clear()
            got[END_TOKEN] += b.num_rows
        yield flush()

    return docs.select(F.col(text).cast("binary")).mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """At most ``most`` tokens: all whose count reaches a bound, the lowest one that admits no more; most frequent first."""
    level = F.floor(F.log2("n") * 64)
    levels = sorted(((r["level"], r["k"]) for r in counts.filter(F.col("token") != F.lit(END_TOKEN)).groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()), reverse=True)
    bound, got = None, 0
    for lv, k in levels:
        if got + k > most:
            break
        bound, got = lv, got + k
    if bound is None:
        return {}
    rows = counts.filter((F.col("token") != F.lit(END_TOKEN)) & (level >= bound)).collect()
    return {bytes(r["token"]): r["n"] for r in sorted(rows, key=lambda r: (-r["n"], bytes(r["token"])))}


class Places(dict):
    """Token -> place; ``other`` for any other token."""

    def __init__(self, places: dict[bytes, int], other: int):
        super().__init__(places)
        self.other = other

    def __missing__(self, token: bytes) -> int:
        return self.other

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.int32, len(ws))


def fit(docs: DataFrame, training: Column, text: str = "text", key: str = "doc_id", classes: int = 32, members: int = 48, inputs: int = 16, hidden: int = 24, head: int = 100_000, rounds: int = 3, fraction: float = 1.0, rate: float = 0.01, seed: int = 5) -> LanguageModel:
    """Count and train on the rows that ``training`` selects.

    By default the recurrent model learns from every training document once, whatever the size; the rounds divide the
    documents by hash of the key. fraction: for callers that want less, the share of documents that it learns from.
    head: bound of the frequent-token table. Without training rows
    every token is unknown and the model knows only the unknown and the end token.
    """
    spark = docs.sparkSession
    ship_package(spark)
    learn = docs.filter(training)
    counts = stored(count_tokens(learn, text), "counts").filter("n > 0")
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.when(F.col("token") == F.lit(END_TOKEN), F.col("n"))).alias("ends")).first()
    total, distinct, ends = sums["n"] or 0, sums["k"], sums["ends"] or 0
    top = frequent(counts, head)
    words = {w: i + 2 for i, w in enumerate(list(top)[: classes * members - 2])}
    freq = np.full(classes * members, 0.5)
    freq[UNKNOWN] += total - ends - sum(top[w] for w in words)
    freq[END] += ends
    for w, i in words.items():
        freq[i] += top[w]
    shape = (classes, members, inputs, hidden)
    model = Gru(*shape, log_freq=np.log(freq / freq.sum()), seed=seed)
    weights = model.flat()
    parts = 1 << 20
    slot = F.pmod(F.xxhash64(F.lit("slice"), F.col(key)), F.lit(parts))
    for k in range(rounds if total else 0):
        first, end = (math.ceil(parts * fraction * i / rounds) for i in (k, k + 1))
        one = learn.filter((slot >= first) & (slot < end)).select(F.col(text).cast("binary"))
        weights = _round(spark, one, shape, words, weights, rate / (1 + k))
    return LanguageModel(counts, total, distinct, ends, top, words, shape, weights)


def _round(spark, docs: DataFrame, shape, words, weights: np.ndarray, rate: float, tokens_at_once: int = 1_000_000) -> np.ndarray:
    """Train in every task from the same weights; the average by tokens. One row per weight and task is summed by Spark."""
    given = spark.sparkContext.broadcast((words, weights))

    def learn(batches):
        one_thread()
        words, start = given.value
        model = Gru(*shape)
        model.load(start)
        places = Places(words, UNKNOWN)
        opt, held, n, waiting = None, [], 0, 0
        for b in batches:
            for t in b.column(0):
                held.append(np.append(places.of(tokens(t.as_py())), np.int32(END)))
                n, waiting = n + len(held[-1]), waiting + len(held[-1])
                if waiting >= tokens_at_once:
                    opt = train(model, held, rate, opt=opt)
                    held, waiting = [], 0
        if held:
            train(model, held, rate, opt=opt)
        if n:
            moved = np.round((model.flat().astype(np.float64) - start) * SCALE / 1024).astype(np.int64)
            at = np.flatnonzero(moved)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(moved[at] * n // 1024, n))], ["at", "moved"])

    sums = docs.mapInArrow(learn, "at long, moved long").groupBy("at").agg(F.sum(F.col("moved").cast("decimal(38,0)")).alias("moved")).collect()
    given.unpersist()
    got = {r["at"]: int(r["moved"]) for r in sums}
    n = got.pop(-1, 0)
    out = weights.astype(np.float64)
    for at, moved in got.items():
        out[at] += moved / n * 1024 * 1024 / SCALE
    return out.astype(np.float32)


def score_texts(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row: key, ``n_tokens``, ``n_known``, ``base_score``, ``score``.

    base_score: log10 probability under add-one unigrams; score: log10 probability under the recurrent model. Null
    texts are empty: one end token. Repeated rows and null keys give rows like others; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    given = spark.sparkContext.broadcast((model.head, model.words, model.weights, model.ends))
    shape = model.shape
    kind = docs.select(key).schema[0].dataType.simpleString()
    names = ["k", "n_tokens", "known", "head_log", "n_other", "other_log", "gru_log", "tail"]
    tail_t = pa.list_(pa.struct([("token", pa.binary()), ("m", pa.int64())]))

    def run(batches):
        one_thread()
        head, words, weights, ends = given.value
        net = Gru(*shape)
        net.load(weights)
        place = Places({w: i for i, w in enumerate(head)}, -1)
        n_words = len(words)
        logs = np.log10(np.array([*head.values(), 0], np.float64) + 1)  # the last one is that of no token

        def look_up(texts):
            """Ids of each text for the network, and the columns that counts give."""
            split = [tokens(t.as_py()) for t in texts]
            size = np.array([len(ws) for ws in split], np.int64)
            at = np.concatenate([place.of(ws) for ws in split]) if split else np.zeros(0, np.int32)
            doc, other = np.repeat(np.arange(len(split)), size), (at < 0) | (at >= n_words)
            sums = lambda w: np.bincount(doc, weights=w, minlength=len(split))
            log = logs[at]
            cols = [size + 1, sums(at >= 0).astype(np.int64) + (ends > 0), sums(log) + math.log10(ends + 1), sums(other).astype(np.int64), sums(np.where(other, log, 0.0))]
            rare = at < 0
            ends_at = np.cumsum(size)
            ids = np.insert(np.where(other, UNKNOWN, at + 2), ends_at, END).astype(np.int32)
            first = ends_at - size
            tails: list[list] = [[] for _ in split]
            for k in np.unique(doc[rare]).tolist():
                own = np.flatnonzero(rare[first[k] : ends_at[k]])
                tails[k] = [{"token": w, "m": m} for w, m in Counter(split[k][j] for j in own).items()]
            return np.split(ids, (ends_at + np.arange(1, len(split) + 1))[:-1]), cols, tails

        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                b = batch.slice(at, 10_000)
                parts = [look_up(b.column(1).slice(lo, 1_000)) for lo in range(0, b.num_rows, 1_000)]
                ids = [x for p in parts for x in p[0]]
                cols = [np.concatenate([p[1][k] for p in parts]) for k in range(5)]
                tails = [x for p in parts for x in p[2]]
                yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, cols), pa.array(score(net, ids) / math.log(10)), pa.array(tails, tail_t)], names)

    scored = docs.select(F.col(key).alias("k"), F.col(text).cast("binary")).mapInArrow(run, f"k {kind}, n_tokens long, known long, head_log double, n_other long, other_log double, gru_log double, tail array<struct<token:binary,m:bigint>>")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = scored.select("row", F.inline("tail")).join(model.counts, "token", "left")
    # logarithms are summed as integers, so that the order in which rows meet doesn't matter
    rare = rare.groupBy("row").agg(F.sum(F.col("m") * F.round(F.log10(F.coalesce("n", F.lit(0)) + 1) * 1e12).cast("long")).alias("log"), F.sum(F.when(F.col("n").isNotNull(), F.col("m")).otherwise(0)).alias("known"))
    both = scored.drop("tail").join(rare.withColumnRenamed("known", "rare_known"), "row", "left")
    rare_log = F.coalesce(F.col("log") / 1e12, F.lit(0.0))
    base = F.col("head_log") + rare_log - F.col("n_tokens") * F.lit(math.log10(model.total + model.distinct + 1))
    own = F.col("gru_log") + F.col("other_log") + rare_log - F.col("n_other") * F.lit(math.log10(model.others))
    return both.select(F.col("k").alias(key), "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), base.alias("base_score"), own.alias("score"))


@query("op8_lm_score")
def op8_lm_score(spark, sf):
    docs = table(spark, sf, "documents")
    model = fit(docs, crc_mod("doc_id", 7) != 2)
    held_out = (crc_mod("doc_id", 7) == 2).alias("held_out")
    return score_texts(docs, model).select("doc_id", held_out, "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
