"""Scorers for one Arrow batch of rows against a bounded batch of queries.

They run inside tasks: Spark partitions the corpus, each task scores its rows against the query batch and keeps
the best k per query. Entries of list columns are numbered by Arrow; each distinct one is looked up once, as bits over the
queries, and rows are summed over those bits, so what is done in Python follows the vocabulary of a batch.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidekb import rules
from tidekb.functions.vectors import unit_rows

WORD = re.compile(r"[^ \t\n\r\f\v]+")
#: Bytes of the bits that a cache of strings keeps, and of what is unpacked at once.
CACHE_BYTES, AT_ONCE = 1 << 24, 1 << 20
#: About how many bytes the parts of all query words may take; if they take more, strings are looked for in the words instead.
PARTS_BYTES = 1 << 26
#: Suffixes of query words are kept to this many characters; longer strings are searched for in the queries themselves.
SUFFIX = 64
#: Bytes of strings that are searched at once, and strings from which on they are looked for in the queries together.
SEARCHED, TOGETHER = 1 << 16, 64
#: Entries of a row's list that are weighed first; the others count only where a capped sum is still below its cap.
FIRST_ENTRIES = 32


def words_of(text: str, min_len: int = 2) -> list[str]:
    return [w for w in WORD.findall(text.lower()) if len(w) >= min_len]


class Substrings:
    """Positions of the words of a fixed list that occur inside a string, by an Aho-Corasick automaton (pyahocorasick is required)."""

    def __init__(self, words: list[str]):
        self.pos = {w: i for i, w in enumerate(words)}
        self.machine = None
        if words:
            self.machine = ahocorasick.Automaton()
            for w, i in self.pos.items():
                self.machine.add_word(w, i)
            self.machine.make_automaton()

    def __call__(self, s: str) -> tuple[int, ...]:
        return tuple({i for _, i in self.machine.iter(s)}) if self.machine is not None else ()


def lowered(strings: pa.Array) -> pa.Array:
    """Each string as ``str.lower`` gives it; Python sees those with letters beyond ASCII alone."""
    plain = pc.string_is_ascii(strings)
    low = pc.ascii_lower(strings)
    if pc.all(plain).as_py() is not False:
        return low
    other = pc.invert(plain)
    return pc.replace_with_mask(low, other, pa.array([w.lower() for w in strings.filter(other).to_pylist()], low.type))


def _one_word(strings: list[str]) -> np.ndarray:
    """Which strings are one word: not empty, and without white space."""
    a = pa.array(strings, pa.string())
    return pc.and_(pc.not_equal(a, ""), pc.invert(pc.match_substring_regex(a, r"[ \t\n\r\f\v]"))).to_numpy(zero_copy_only=False)


class Occurrences:
    """Where the words of a fixed list occur inside strings, for whole Arrow arrays.

    Strings are searched as UTF-8, in which a word matches at letters only. From every byte the hash grows by one byte at a time
    for as long as some word begins with the same bytes, so few places are left after three; hashes that a word of n bytes has
    (of its first ``LONGEST``, if it is longer) are compared byte by byte.
    """

    LONGEST = 16
    STEP, MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, words: list[str]):
        raw = [w.encode() for w in words]
        self.size = np.array([len(w) for w in raw], np.int32)
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.at = np.cumsum(self.size) - self.size
        self.groups, self.longer = {}, {}
        short = np.minimum(self.size, self.LONGEST)
        keys = np.zeros(len(raw), np.uint64)
        for n in range(1, int(short.max(initial=0)) + 1):
            here = np.flatnonzero(short >= n)
            keys[here] = keys[here] * self.STEP + (self.bytes[self.at[here] + n - 1].astype(np.uint64) + np.uint64(1))
            self.longer[n] = self._table(keys[short > n])
            ids = np.flatnonzero(short == n)
            if len(ids):
                order = np.argsort(keys[ids], kind="stable")
                mine, first, many = np.unique(keys[ids][order], return_index=True, return_counts=True)
                self.groups[n] = self._table(mine), mine, first, many, ids[order]

    def _table(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(1 << 16, bool)
        out[self._slot(keys)] = True
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * self.MIX) >> np.uint64(48)

    def __call__(self, strings: pa.Array):
        """(string, word) of each occurrence, in parts; numbers of strings ascend inside a part. Strings are not null."""
        big = strings.cast(pa.large_string())
        ends = np.frombuffer(big.buffers()[1], np.int64)[big.offset : big.offset + len(big) + 1] if len(big) else np.zeros(1, np.int64)
        text = np.frombuffer(big.buffers()[2], np.uint8) if len(big) and big.buffers()[2] is not None else np.zeros(0, np.uint8)
        i = 0
        while i < len(big):
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + SEARCHED, "right")) - 1)
            for string, word in self._part(text[ends[i] : ends[j]], ends[i : j + 1] - ends[i]):
                if len(string):
                    yield string + i, word
            i = j

    def _part(self, text: np.ndarray, ends: np.ndarray):
        size = np.diff(ends)
        string = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), size)
        left = np.repeat(ends[1:].astype(np.int32), size) - np.arange(len(text), dtype=np.int32)
        code = text.astype(np.uint64) + np.uint64(1)
        key, place_of = code, np.arange(len(text), dtype=np.int32)
        for n in self.longer:
            slot = self._slot(key)
            go_on = np.flatnonzero(self.longer[n][slot] & (left[place_of] > n))
            if n in self.groups:
                known, keys, first, many, ids = self.groups[n]
                some = np.flatnonzero(known[slot])
                at, found = place_of[some], key[some]
            key, place_of = key[go_on], place_of[go_on]
            key = key * self.STEP + code[place_of + n]
            if n not in self.groups:
                continue
            place = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            same = keys[place] == found
            at, place = at[same], place[same]
            if not len(at):
                continue
            times = many[place]
            word = ids[np.repeat(first[place] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
            at = np.repeat(at, times)
            fits = left[at] >= self.size[word]
            at, word = at[fits], word[fits]
            # bytes are compared while words have more of them
            live, j, whole = np.arange(len(at)), 0, np.ones(len(at), bool)
            while len(live):
                same = text[at[live] + j] == self.bytes[self.at[word[live]] + j]
                whole[live[~same]] = False
                live, j = live[same], j + 1
                if j >= n:
                    live = live[self.size[word[live]] > j]
            yield string[at[whole]], word[whole]


class Tokens:
    """The entries of a list column, numbered: distinct entries in lower case, and the row and number of each entry."""

    def __init__(self, lists):
        if not isinstance(lists, pa.Array):
            lists = pa.array(lists, pa.list_(pa.string()))
        flat = lists.flatten()
        size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(len(lists)), size)
        real = pc.fill_null(pc.not_equal(flat, ""), False)
        if pc.all(real).as_py() is False:
            flat, rows = flat.filter(real), rows[real.to_numpy(zero_copy_only=False)]
        numbered = flat.dictionary_encode()
        self.n, self.rows, self.code = len(lists), rows, numbered.indices.to_numpy(zero_copy_only=False)
        self.strings, self.listed = lowered(numbered.dictionary), None

    @property
    def words(self) -> list[str]:
        if self.listed is None:
            self.listed = self.strings.to_pylist()
        return self.listed

    @classmethod
    def of_texts(cls, texts) -> Tokens:
        """Words between white space of each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        return cls(pc.ascii_split_whitespace(texts))

    def spans(self, wide: int):
        """(rows, first entry, entry after the last, first entries by row) of runs of rows that have entries, about ``wide`` entries each."""
        if not len(self.rows):
            return
        start = np.flatnonzero(np.r_[True, self.rows[1:] != self.rows[:-1]])
        end = np.r_[start[1:], len(self.rows)]
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + wide, "right")))
            yield self.rows[start[i:j]], start[i], end[j - 1], start[i:j] - start[i]
            i = j


class Known:
    """Bits of strings, made once per string; bounded: starts afresh when full."""

    def __init__(self, make, columns: int):
        self.make, self.room = make, max(1024, CACHE_BYTES // (8 * max(1, columns)))
        self.at: dict[str, int] = {}
        self.table = np.zeros((256, columns), np.uint64)

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.at) > self.room:
            self.at = {}
        new = list(dict.fromkeys(w for w in words if w not in self.at))
        if new:
            used = len(self.at)
            if used + len(new) > len(self.table):
                self.table = np.concatenate([self.table[:used], np.zeros((max(len(new), used), self.table.shape[1]), np.uint64)])
            self.table[used : used + len(new)] = self.make(new)
            self.at.update(zip(new, range(used, used + len(new))))
        return self.table[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))]


class QueryTexts:
    """Substring relations between any string and the queries, as bits over the queries (64 to a number)."""

    def __init__(self, texts: list[str], min_len: int = 2):
        self.low = [t.lower() for t in texts]
        self.n, self.width = len(texts), -(-len(texts) // 64)
        self.everything = "\x00".join(self.low)
        self.shortest = min((len(t) for t in self.low), default=0)
        self.words = [set(words_of(t, min_len)) for t in texts]
        inner = sorted(set().union(*self.words)) if self.words else []
        self.inner_words = Occurrences(inner)
        self.inner_bits = self._bits_of({w: i for i, w in enumerate(inner)}, self.words)
        whole = [set(WORD.findall(t)) for t in self.low]
        place = {w: i for i, w in enumerate(sorted(set().union(*whole)) if whole else [])}
        self.whole_bits = self._bits_of(place, whole)
        ends = sorted((w[i : i + SUFFIX], k) for w, k in place.items() for i in range(len(w)))
        self.suffixes, self.suffix_word = [e for e, _ in ends], np.array([k for _, k in ends], np.int64)
        self.whole_words = list(place)
        self.parts, self.part_bits = self._parts()
        self.having, self.inside, self.word_within = (Known(f, self.width) for f in (self._having, self._inside, self._word_within))
        self.hit = Known(self._hit, 2 * self.width)
        self.either = Known(lambda new: self._having(new) | self._inside(new), self.width)
        self.enriched = Known(lambda new: self._having(new) | self._word_within(new), self.width)
        heads: dict[str, list[int]] = {}
        for i, t in enumerate(self.low):
            heads.setdefault(t[:SUFFIX], []).append(i)
        self.heads, self.empty = Substrings([h for h in heads if h]), heads.get("", [])
        self.headed = [heads[h] for h in heads if h]

    def _bits_of(self, place: dict[str, int], words: list[set[str]]) -> np.ndarray:
        out = np.zeros((len(place), self.width), np.uint64)
        for i, ws in enumerate(words):
            out[[place[w] for w in ws], i // 64] |= np.uint64(1 << (i % 64))
        return out

    def _parts(self) -> tuple[pa.Array | None, np.ndarray | None]:
        """All parts of the query words, of ``SUFFIX`` characters at most, and the queries that have them; none if they are too many."""
        if sum(len(w) * min(len(w), SUFFIX) for w in self.whole_words) * (self.width + 8) * 8 > PARTS_BYTES:
            return None, None
        at: dict[str, int] = {}
        pairs = [(at.setdefault(w[i:j], len(at)), k) for k, w in enumerate(self.whole_words) for i in range(len(w)) for j in range(i + 1, min(len(w), i + SUFFIX) + 1)]
        bits = np.zeros((max(1, len(at)), self.width), np.uint64)
        if pairs:
            part, word = np.array(pairs, np.int64).T
            order = np.argsort(part, kind="stable")
            bits[:] = np.bitwise_or.reduceat(self.whole_bits[word[order]], np.flatnonzero(np.diff(part[order], prepend=-1)), axis=0)
        return pa.array(list(at), pa.string()), bits

    def _bits(self, queries) -> np.ndarray:
        out = np.zeros(self.width, np.uint64)
        for i in queries:
            out[i // 64] |= np.uint64(1 << (i % 64))
        return out

    def spread(self, bits: np.ndarray) -> np.ndarray:
        """Bits as 0/1 over the queries."""
        return np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1, count=self.n, bitorder="little")

    def _one(self, s: str) -> np.ndarray | None:
        """Queries that contain ``s``."""
        parts = WORD.findall(s)
        if len(parts) == 1 and parts[0] == s and len(s) <= SUFFIX:
            lo = bisect_left(self.suffixes, s)
            hi = bisect_left(self.suffixes, s + "\U0010ffff", lo)
            while hi < len(self.suffixes) and self.suffixes[hi].startswith(s):
                hi += 1
            return np.bitwise_or.reduce(self.whole_bits[self.suffix_word[lo:hi]], axis=0) if hi > lo else None
        maybe = np.full(self.width, ~np.uint64(0))
        for p in parts:
            found = self._one(p) if len(p) <= SUFFIX and p != s else maybe
            if found is None:
                return None
            maybe = maybe & found
        return self._bits(i for i in np.flatnonzero(self.spread(maybe[None, :])[0]) if s in self.low[i]) if maybe.any() else None

    def _having(self, new: list[str]) -> np.ndarray:
        """Queries that contain each string; the strings are distinct."""
        out = np.zeros((len(new), self.width), np.uint64)
        single = np.flatnonzero(_one_word(new)).tolist() if len(new) >= TOGETHER else []
        if single and self.parts is not None:
            at = pc.fill_null(pc.index_in(pa.array([new[i] for i in single], pa.string()), self.parts), -1).to_numpy(zero_copy_only=False)
            out[single] = np.where(at[:, None] >= 0, self.part_bits[at], np.uint64(0))
            single = [i for i in single if len(new[i]) <= SUFFIX]
        elif single:
            # many strings without white space: all are looked for at once in the distinct query words
            machine = ahocorasick.Automaton()
            for i in single:
                machine.add_word(new[i], i)
            machine.make_automaton()
            pairs = [(i, k) for k, w in enumerate(self.whole_words) for _, i in machine.iter(w)]
            if pairs:
                string, word = np.array(pairs, np.int64).T
                order = np.argsort(string, kind="stable")
                string, word = string[order], word[order]
                starts = np.flatnonzero(np.r_[True, string[1:] != string[:-1]])
                out[string[starts]] = np.bitwise_or.reduceat(self.whole_bits[word], starts, axis=0)
        done = set(single)
        for i, s in enumerate(new):
            if i not in done:
                found = self._one(s)
                if found is not None:
                    out[i] = found
        return out

    def _inside(self, new: list[str]) -> np.ndarray:
        """Queries that are contained in each string."""
        out = np.zeros((len(new), self.width), np.uint64)
        for i, s in enumerate(new):
            if len(s) >= self.shortest:
                out[i] = self._bits(k for k, q in enumerate(self.low) if q in s)
        return out

    def _word_within(self, new: list[str]) -> np.ndarray:
        """Queries with a word that occurs inside each string."""
        out = np.zeros((len(new), self.width), np.uint64)
        for string, word in self.inner_words(pa.array(new, pa.string())):
            starts = np.flatnonzero(np.r_[True, string[1:] != string[:-1]])
            out[string[starts]] |= np.bitwise_or.reduceat(self.inner_bits[word], starts, axis=0)
        return out

    def _hit(self, new: list[str]) -> np.ndarray:
        """Hits of each keyword: the queries of the three full layers, and others that share its two-character head."""
        full = self._word_within(new)
        # a query that contains the keyword contains its words
        one = _one_word(new)
        full[one] |= self._having([new[i] for i in np.flatnonzero(one)])
        rest = np.flatnonzero(~one)
        parts = [words_of(new[i]) or [new[i]] for i in rest]
        each = {p: i for i, p in enumerate(dict.fromkeys(p for ps in parts for p in ps))}
        found = self._having(list(each))
        for i, ps in zip(rest, parts):
            for p in ps:
                full[i] |= found[each[p]]
        strings = pa.array(new, pa.string())
        heads = pc.utf8_slice_codeunits(strings, 0, 2).dictionary_encode()
        half = self.having(heads.dictionary.to_pylist())[heads.indices.to_numpy(zero_copy_only=False)] if len(new) else np.zeros_like(full)
        half[pc.less(pc.utf8_length(strings), 2).to_numpy(zero_copy_only=False)] = 0
        return np.concatenate([full, half & ~full], axis=1)

    def _sums(self, t: Tokens, bits: np.ndarray, weights: tuple[int, ...] = (1,)) -> np.ndarray:
        """Rows x queries: the weights of each row's entries, summed. ``bits``: by distinct entry, a part for each weight."""
        out = np.zeros((t.n, self.n))
        for rows, lo, hi, starts in t.spans(max(1, AT_ONCE // max(1, self.n))):
            at = bits[t.code[lo:hi]]
            each = sum(np.uint8(w) * self.spread(at[:, k * self.width : (k + 1) * self.width]) for k, w in enumerate(weights))
            out[rows] = np.add.reduceat(each, starts, axis=0, dtype=np.int32)
        return out

    def any_of(self, lists, relation: Known) -> np.ndarray:
        """Rows x queries: does an entry of the row have the relation to the query?"""
        t = lists if isinstance(lists, Tokens) else Tokens(lists)
        bits, out = relation(t.words), np.zeros((t.n, self.n), dtype=bool)
        for rows, lo, hi, starts in t.spans(max(1, AT_ONCE // max(1, self.width))):
            out[rows] = self.spread(np.bitwise_or.reduceat(bits[t.code[lo:hi]], starts, axis=0))
        return out

    def count_of(self, lists, relation: Known) -> np.ndarray:
        """Rows x queries: how many entries of the row have the relation to the query."""
        t = lists if isinstance(lists, Tokens) else Tokens(lists)
        return self._sums(t, relation(t.words))

    def keyword_boost(self, lists) -> np.ndarray:
        if isinstance(lists, Tokens):
            twice = self._sums(lists, self.hit(lists.words), (2, 1))
        else:
            lists = lists if isinstance(lists, pa.Array) else pa.array(lists, pa.list_(pa.string()))
            t = Tokens(pc.list_slice(lists, 0, FIRST_ENTRIES))
            twice = self._sums(t, self.hit(t.words), (2, 1))
            # a sum at its cap stays there, so other entries matter only to rows with a lower one
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            rest = np.flatnonzero((size > FIRST_ENTRIES) & (twice < 2 * rules.KEYWORD_MAX_HITS).any(axis=1))
            if len(rest):
                t = Tokens(pc.list_slice(lists.take(pa.array(rest)), FIRST_ENTRIES))
                twice[rest] += self._sums(t, self.hit(t.words), (2, 1))
        return rules.KEYWORD_HIT * np.minimum(twice / 2, rules.KEYWORD_MAX_HITS)

    def synonym_bonus(self, lists) -> np.ndarray:
        return rules.SYNONYM_BONUS * self.any_of(lists, self.either)

    def whole(self, texts: list[str]) -> np.ndarray:
        """Texts x queries: is the whole query inside the text?"""
        out = np.zeros((len(texts), self.n), dtype=bool)
        out[:, self.empty] = True
        for i, t in enumerate(texts):
            t = t.lower()
            for h in self.heads(t):
                for k in self.headed[h]:
                    out[i, k] = self.low[k] in t
        return out


class TermIndex:
    """Which of the queries' distinct terms occur in a text, by substring or as whole words."""

    def __init__(self, term_sets: list[set[str]]):
        self.terms = sorted(set().union(*term_sets)) if term_sets else []
        self.inner = Occurrences(self.terms)
        self.pos = {w: i for i, w in enumerate(self.terms)}
        self.listed = pa.array(self.terms, pa.string())
        self.incidence = np.zeros((len(self.terms), len(term_sets)), dtype=np.float32)
        for q, ts in enumerate(term_sets):
            self.incidence[[self.pos[t] for t in ts], q] = 1.0

    def _counts(self, t: Tokens, entry: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Rows × queries: how many of each query's terms were found (small whole numbers, exact in single precision).

        ``entry``, ``term``: pairs of a distinct entry and a term found in it."""
        out = np.zeros((t.n, self.incidence.shape[1]))
        order = np.argsort(entry, kind="stable")
        ids, size = term[order], np.bincount(entry, minlength=len(t.strings))
        first = np.cumsum(size) - size
        held = size[t.code] > 0
        rows, code = t.rows[held], t.code[held]
        step = max(1, AT_ONCE // max(1, len(self.terms)))
        for lo in range(0, t.n, step):
            a, b = np.searchsorted(rows, [lo, lo + step])
            if a == b:
                continue
            n = size[code[a:b]]
            at = np.repeat(first[code[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            flags = np.zeros((min(step, t.n - lo), len(self.terms)), dtype=np.float32)
            flags[np.repeat(rows[a:b] - lo, n), ids[at]] = 1.0
            out[lo : lo + step] = flags @ self.incidence
        return out

    def contained(self, texts) -> np.ndarray:
        """Number of each query's terms that occur anywhere in each text (terms hold no white space)."""
        t = texts if isinstance(texts, Tokens) else Tokens.of_texts(texts)
        found = [*self.inner(t.strings), (np.zeros(0, np.int64), np.zeros(0, np.int64))]
        return self._counts(t, np.concatenate([e for e, _ in found]), np.concatenate([w for _, w in found]))

    def shared(self, lists) -> np.ndarray:
        """Number of each query's terms among each row's distinct tokens, in lower case."""
        t = lists if isinstance(lists, Tokens) else Tokens(lists)
        at = pc.fill_null(pc.index_in(t.strings, self.listed.cast(t.strings.type)), -1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(at >= 0)
        return self._counts(t, known, at[known])


class Labels:
    """Number of a query's labels that a row has (labels are few, and compared as they are)."""

    def __init__(self, query_labels: list[set[str]]):
        self.names = sorted(set().union(*query_labels)) if query_labels else []
        self.of = np.array([[x in ls for ls in query_labels] for x in self.names], dtype=np.float64).reshape(len(self.names), len(query_labels))

    def __call__(self, rows: list[list[str] | None]) -> np.ndarray:
        return np.array([[x in (r or ()) for x in self.names] for r in rows], dtype=np.float64).reshape(len(rows), len(self.names)) @ self.of


def infer_labels(text: str, hints: dict[str, list[str]]) -> set[str]:
    return {lab for lab, hs in hints.items() if any(h in text for h in hs)}


class MetadataScore:
    """Phrase, surface, label, exact-term, tier and negative signals of each row for each query."""

    def __init__(self, texts: list[str], text_chars: int | None = None, max_tokens: int | None = None, asked: QueryTexts | None = None):
        self.q = asked or QueryTexts(texts)
        self.chars, self.max_tokens = text_chars, max_tokens
        self.labels = [Labels([infer_labels(t, hints) for t in self.q.low]) for hints in (rules.QUERY_CATEGORY_HINTS, rules.QUERY_INTENT_HINTS, rules.QUERY_SCENARIO_HINTS)]
        self.tokens = TermIndex([set(self.cut(t)) for t in texts])
        self.terms = TermIndex(self.q.words)

    def cut(self, text: str) -> list[str]:
        return words_of(text if self.chars is None else text[: self.chars])[: self.max_tokens]

    def overlaps(self, col, weights: tuple[float, float, float]) -> np.ndarray:
        """Weighted overlaps of categories, intents and scenarios."""
        return sum(w * of(col(c)) for w, of, c in zip(weights, self.labels, ("categories", "intent_labels", "scenario_tags")))

    def tiers(self, col, base: dict[str, float], other: float, hit: float, negative: float) -> np.ndarray:
        """Value of each row's tier, ``hit`` more for a booster aimed at the query, and ``negative`` for a negative term in it."""
        tier = [(t or "canonical").lower() for t in col("serving_tier")]
        out = np.array([base.get(t, other) for t in tier])[:, None] + negative * self.q.any_of(col.arrow("hard_negative_terms"), self.q.having)
        booster = np.array([t == "booster" for t in tier])
        if booster.any():
            out += hit * (booster[:, None] & self.q.any_of(col.arrow("booster_target_queries"), self.q.having))
        return out

    def __call__(self, col) -> np.ndarray:
        surface = col.arrow("retrieval_surface_text")
        tokens = Tokens.of_texts(surface)
        cut = tokens if self.chars is None and self.max_tokens is None else Tokens([self.cut(s or "") for s in surface.to_pylist()])
        out = rules.PHRASE_FACTOR * self.q.keyword_boost(col.arrow("retrieval_phrases"))
        out += rules.SURFACE_TOKEN * self.tokens.shared(cut)
        out += self.overlaps(col, (rules.CATEGORY_OVERLAP, rules.INTENT_OVERLAP, rules.SCENARIO_OVERLAP))
        out += rules.EXACT_TERM * self.terms.contained(tokens)
        tiers = {"booster": rules.TIER_BOOSTER_MISS, "supporting": rules.TIER_SUPPORTING}
        return out + self.tiers(col, tiers, rules.TIER_CANONICAL, rules.TIER_BOOSTER_HIT - rules.TIER_BOOSTER_MISS, rules.HARD_NEGATIVE)


def cosine(query_vectors: np.ndarray, rows) -> np.ndarray:
    return unit_rows(rows, query_vectors.shape[1]) @ query_vectors.T
