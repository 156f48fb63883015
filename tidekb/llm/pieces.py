"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (blank handling), the lexicon (a transducer from
characters to piece ids, with a byte-fallback path for characters that no piece covers) and, for models of the merging
kind, an acceptor over pairs of neighbouring pieces. They are composed with each input lazily, arc by arc, and the
shortest path in the tropical semiring is the encoding:

- unigram models: an arc weighs minus its piece's score and the pair acceptor accepts everything with weight 0;
- merge (BPE) models: the pair acceptor weighs 0 where merging the two pieces' text gives back these two pieces, else
  infinity. A sequence of pieces is what merging yields if and only if every neighbouring pair is, so one path of
  finite weight is left, and it equals the merge algorithm's result.

Decoding runs the lexicon the other way round.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidekb.llm.common import kept, query, table
from tidekb.session import ship_package

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Fixed values of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Added to the smallest score for a character that nothing covers (unigram models), as the format's library does.
UNKNOWN_PENALTY = 10.0


class Normaliser:
    """Blank handling as a transducer with two states, at a word's start and inside one.

    Space becomes the space mark; runs and outer blanks go if the model says so; one mark may be put before the text.
    """

    def __init__(self, add_prefix: bool, drop_extra: bool, escape: bool):
        self.add_prefix, self.drop_extra, self.mark = add_prefix, drop_extra, SPACE if escape else " "

    def forward(self, text: str) -> str:
        if self.drop_extra:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (self.mark if self.add_prefix else "") + text.replace(" ", self.mark)

    def backward(self, text: str) -> str:
        text = text.replace(self.mark, " ")
        return text[1:] if self.add_prefix and text.startswith(" ") else text


class PieceTransducer:
    """The machines of one model; ``encode`` and ``decode`` are exact inverses on texts that normalise to themselves."""

    def __init__(self, model: bytes, memory: int = 250_000):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if norm.precompiled_charsmap or train.treat_whitespace_as_suffix or train.model_type not in (UNIGRAM, BPE):
            raise ValueError("only models with an identity character map, blanks before words, and unigram or merge pieces are supported")
        self.normaliser = Normaliser(norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces)
        self.merging = train.model_type == BPE
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)}
        if any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.scores = [p.score for p in proto.pieces]
        self.longest = max(map(len, self.ids), default=1)
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE} if train.byte_fallback else {}
        self.out = [bytes([int(p.piece[1:-1], 16)]) if p.type == BYTE else p.piece.encode() if p.type == NORMAL else b"" for p in proto.pieces]
        self.out[self.unknown] = proto.trainer_spec.unk_surface.encode() if proto.trainer_spec.unk_surface else b" \xe2\x81\x87 "
        self.floor = min([self.scores[i] for i in self.ids.values()], default=0.0) - UNKNOWN_PENALTY
        #: Paths never cross a place that no piece spans, so the parts of a text between such places are independent: where the
        #: space mark follows another character, and where a mark that follows no letter in any piece follows a letter.
        spanned = {p[k + 1] for p in self.ids for k in range(len(p) - 1) if p[k].isalpha()}
        marks = "".join(re.escape(c) for c in "\n\t!\"#$%&()*+,-./:;<=>?@[]^_`{|}~" if c not in spanned)
        word = f"{SPACE}*[^\\W\\d_]+(?=[{marks}])|" if marks else ""
        self.cut = re.compile(f"{word}{SPACE}*[^{SPACE}]+|{SPACE}+" if not any(SPACE in p.lstrip(SPACE) for p in self.ids) else "(?s).+")
        self.texts = {i: p for p, i in self.ids.items()}
        self.memory = memory
        self.known: dict[str, bytes] = {}
        if self.merging:
            self.ids = {p: i for p, i in self.ids.items() if self.merged(p) == [p]}  # pieces that merging never yields have no arc
        times = Counter(self.scores[i] for i in self.ids.values())
        self.tied = frozenset(i for i in self.ids.values() if times[self.scores[i]] > 1 and len(self.texts[i]) > 1)
        #: Per piece: the two pieces that the last merge joins; none for single characters.
        self.halves: dict[int, tuple[int, int] | None] = {}
        #: Arcs of the pair acceptor compiled so far, by a * number of pieces + b.
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str, until: int = 1) -> list[str]:
        """Merging proper, on the text of a piece or two, to compile arcs; the leftmost best pair first, until so many parts are left."""
        parts = list(text)
        while len(parts) > until:
            best, at = -math.inf, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and self.scores[i] > best:
                    best, at = self.scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def half(self, i: int) -> tuple[int, int] | None:
        if i not in self.halves:
            parts = self.merged(self.texts[i], 2)
            self.halves[i] = (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else None
        return self.halves[i]

    def accepts(self, a: int, b: int) -> bool:
        """Whether merging the text of a and b gives back a and b.

        It doesn't if, at some time, the pieces at their border would have merged before the next merge that made a or b.
        The merges are walked backwards, the latest first; of equal scores the left one comes first. Pieces that share a score are merged outright.
        """
        if a in self.tied or b in self.tied:
            return self.merged(self.texts[a] + self.texts[b]) == [self.texts[a], self.texts[b]]
        scores, ids, texts, limit, even = self.scores, self.ids, self.texts, -math.inf, False
        while True:
            i = ids.get(texts[a] + texts[b])
            if i is not None and (scores[i] > limit or even and scores[i] == limit):
                return False
            left, right = self.half(a), self.half(b)
            if left and (not right or scores[a] < scores[b]):
                limit, even, a = scores[a], False, left[1]
            elif right:
                limit, even, b = scores[b], True, right[0]
            else:
                return True

    def accept(self, at: int) -> bool:
        if len(self.pairs) > self.memory:
            self.pairs.clear()
        a, b = divmod(at, len(self.scores))
        got = self.pairs[at] = self.accepts(a, b)
        return got

    def shortest_path(self, part: str) -> list[int]:
        """Ids on the shortest path through the composition of ``part`` with the machines, -1 - k for a character k without a piece.

        States are (characters read, last piece). For merge models at most one state per place has finite weight, as
        the merging of each prefix is unique; for unigram models the last piece doesn't matter. So one state is kept per place.
        """
        n, get, scores, merging, longest, pairs, kinds = len(part), self.ids.get, self.scores, self.merging, self.longest, self.pairs, len(self.scores)
        cost, last, back = [math.inf] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for end in range(1, n + 1):
            for begin in range(end - 1, max(-1, end - longest - 1), -1):
                i = get(part[begin:end])
                if i is None:
                    continue
                if merging:
                    if (a := last[begin]) >= 0:
                        ok = pairs.get(at := a * kinds + i)
                        if not (self.accept(at) if ok is None else ok):
                            continue
                    elif cost[begin]:  # no path of finite weight leads here
                        continue
                    cost[end], last[end], back[end] = 0.0, i, begin
                    break
                if cost[begin] - scores[i] < cost[end]:
                    cost[end], last[end], back[end] = cost[begin] - scores[i], i, begin
            if (weight := cost[end - 1] - (0.0 if merging else self.floor)) < cost[end] and get(part[end - 1]) is None:
                cost[end], last[end], back[end] = weight, -1 - ord(part[end - 1]), end - 1
        path, at = [], n
        while at:
            path.append(last[at])
            at = back[at]
        return path[::-1]

    def emit(self, part: str) -> bytes:
        """Output ids of a part as int32 bytes, remembered for parts of common length."""
        out: list[int] = []
        for i in self.shortest_path(part):
            if i >= 0:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in chr(-1 - i).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        ids = array("i", out).tobytes()
        if len(part) <= 48:
            if len(self.known) >= self.memory:
                self.known.clear()
            self.known[part] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        known, emit = self.known, self.emit
        return np.frombuffer(b"".join([known.get(p) or emit(p) for p in self.cut.findall(self.normaliser.forward(text))]), np.int32)

    def decode(self, ids) -> str:
        out = self.out
        return self.normaliser.backward(b"".join(map(out.__getitem__, ids)).decode("utf-8", "replace"))


def _transducer(name: str) -> PieceTransducer:
    """One per Python worker, kept between tasks."""

    def load() -> PieceTransducer:
        with open(SparkFiles.get(name), "rb") as f:
            return PieceTransducer(f.read())

    return kept(f"pieces {name}", load)


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """One row per document: key, ``n_tokens``, ``ids`` array<int>, ``round_trip``: whether decoding gives the text back.

    Null and empty texts have no ids and count as a round trip of the empty text. The space mark in a text decodes to a
    space, as the model format has it; that is the only text of an identity model that doesn't come back. Keys and
    repeated rows pass through. Texts are read whole; memory is a batch of texts and a bounded table of words.
    """
    spark = docs.sparkSession
    ship_package(spark)
    spark.sparkContext.addFile(model)
    name, kind = model.rsplit("/", 1)[-1], docs.select(key).schema[0].dataType.simpleString()

    def encode(batches):
        t = _transducer(name)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                texts = [x.as_py() or "" for x in b.column(1)]
                ids = [t.encode(x) for x in texts]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids))
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, pa.int32()))
                same = [t.decode(i.tolist()) == x for i, x in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), lists, pa.array(same, pa.bool_())], ["k", "n_tokens", "ids", "round_trip"])

    return docs.select(F.col(key).alias("k"), text).mapInArrow(encode, f"k {kind}, n_tokens long, ids array<int>, round_trip boolean").withColumnRenamed("k", key)


def decode_ids(rows: DataFrame, key: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """(key, text) from rows with an id array; null arrays give null texts, ids out of range raise IndexError."""
    spark = rows.sparkSession
    ship_package(spark)
    spark.sparkContext.addFile(model)
    name, kind = model.rsplit("/", 1)[-1], rows.select(key).schema[0].dataType.simpleString()

    def decode(batches):
        t = _transducer(name)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if (x := v.as_py()) is None else t.decode(x) for v in b.column(1)], pa.string())], ["k", "text"])

    return rows.select(F.col(key).alias("k"), ids).mapInArrow(decode, f"k {kind}, text string").withColumnRenamed("k", key)


@query("op10_sentencepiece")
def op10_sentencepiece(spark, sf):
    return encode_texts(table(spark, sf, "documents"))
