"""License scan, language ID, pieces and language model against plain restatements, with odd rows and empty tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidekb.llm import gru, langid, licenses, lmscore, pieces


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def test_license_scan_against_brute_force(spark):
    filler = [f"w{i}" for i in range(200)]
    rows = [
        (1, "Released under the MIT License."), (2, "under the mit  license, UNDER THE MIT LICENSE"), (3, None), (4, ""), (5, "Apache License, Version 2.0; CC BY-NC 4.0"),
        (6, " ".join(filler[:90]) + " This work is licensed under the GNU General Public License, version 3. " + " ".join(filler)), (7, "this work is under a license of the general public"),
        (8, "é".join(filler)), (8, "cc by nc"), (None, "the license mit under"), (9, " ".join(filler * 300) + " cc by nc"),
    ]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit(1))).collect()
    assert len(got) == len(rows)
    for (key, text), r in zip(rows, sorted(got, key=lambda r: [i for i, x in enumerate(rows) if x[0] == r.doc_id][0])):
        if key == 8:
            continue
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
        places = {(label, i) for phrase, label in licenses.PHRASES.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()}
        assert (r.doc_id, r.n_words, {(p.label, p.word) for p in r.places}) == (key, len(ws), places)
        starts = range(0, max(0, -(-(len(ws) - 48) // 24)) * 24 + 1, 24)
        blocks = {(label, b) for label, texts in licenses.TEMPLATES.items() for t in texts for b in starts if len(s := set(t.split())) and len(s & set(ws[b : b + 48])) >= 0.8 * len(s)}
        assert {(p.label, p.word) for p in r.blocks} == blocks
    by = {r.doc_id: r for r in got if r.doc_id != 8}
    assert {p.label for p in by[6].blocks} == {"gpl-3"} and not by[7].blocks and {p.label for p in by[None].blocks} == {"mit"}


def test_license_scan_empty_table_and_limits(spark, no_docs):
    assert licenses.scan_licenses(no_docs).count() == 0
    with pytest.raises(ValueError):
        licenses.scan_licenses(no_docs, templates={"x": ["a" * 1_000_001]})


def test_language_id(spark, docs, no_docs):
    model = langid.fit(docs)
    rows = langid.identify(docs, model).collect()
    assert len(rows) == docs.count()
    long_enough = [r for r in rows if r.lang and r.text and len(r.text.split()) > 5 and r.doc_id not in (200, 201, 202, 203)]
    assert sum(r.lang_pred == r.lang for r in long_enough) >= 0.97 * len(long_enough)
    assert all((r.lang_pred, r.lang_score) == ("und", 0.0) for r in rows if not re.search(r"[^\W\d_]", r.text or ""))
    assert all(0 <= r.lang_score <= 1 for r in rows)
    unseen = spark.createDataFrame([(1, "steinlich wasserung"), (2, "maisonette fenêtres")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.identify(unseen, model).orderBy("doc_id").collect()] == ["de", "fr"]
    none = langid.fit(no_docs)
    assert langid.identify(no_docs, none).count() == 0 and {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def test_language_sample_keeps_rare_languages_and_null_keys(spark):
    vocabulary = {"en": "river stone", "fr": "maison lumière", "de": "wasser fenster"}
    rows = [(None if i % 2 else i, f"{vocabulary[la]} {vocabulary[la]} {la}{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}", la) for la, n in (("en", 6_000), ("fr", 900), ("de", 4)) for i in range(n)]
    many = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(many, max_docs=60, max_words=12, max_grams=60)
    assert model.langs == ["de", "en", "fr"]
    assert {w for ws in vocabulary.values() for w in ws.split()} <= set(model.word_at)
    assert [x for x, _ in langid.Scorer(model).predict(["wasser", "river", "maison"])] == ["de", "en", "fr"]
    nameless = many.filter("lang = 'fr'").withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.concat("text", F.lit(" "), F.monotonically_increasing_id()))
    assert langid.fit(nameless, max_docs=100).langs == ["fr"]


def test_language_scores_match_a_plain_sum(docs):
    model = langid.fit(docs)
    for room in (60, 5_000):
        scorer = langid.Scorer(model, room)
        texts = ["the house qwertz " * 40, "rivière", None, "zzz xxx " + "wasser licht " * 30]
        for text, (lang, score) in zip(texts, scorer.predict(texts, at_once=50)):
            total = [sum((model.word_log[model.word_at[w]] if w in model.word_at else model.backed_off([w])[0])[k] for w in langid.words(text)) for k in range(len(model.langs))]
            if text is None:
                assert (lang, score) == ("und", 0.0)
            else:
                assert lang == model.langs[int(np.argmax(total))] and score == pytest.approx(1 / sum(math.exp(t - max(total)) for t in total), abs=1e-4)


def test_language_model_and_backoff_restated(docs):
    """Counts, cuts, log frequencies and the backoff written out plainly, with nothing taken from the operator."""
    import re
    from collections import Counter

    labelled = [(r.text, r.lang) for r in docs.collect() if r.text is not None and r.lang is not None]
    langs = sorted({la for _, la in labelled})
    split = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    tables = []
    for items in (lambda w: [w], lambda w: [f"<{w}>"[i:j] for i in range(len(w) + 2) for j in range(i + 1, min(i + 5, len(w) + 2) + 1)]):
        by = {la: Counter(x for t, l2 in labelled if l2 == la for w in split(t) for x in items(w)) for la in langs}
        known = [x for x, n in sum(by.values(), Counter()).items() if n > 1]
        tables.append({x: [math.log((by[la][x] + 0.1) / (sum(by[la].values()) + 0.1 * (len(known) + 1))) for la in langs] for x in known})
    words, grams = tables

    def word(w):
        if w in words:
            return words[w]
        marked, rows, lost = f"<{w}>", [], 0
        for i in range(len(marked) - 1):
            for n in range(min(5, len(marked) - i), 0, -1):
                if marked[i : i + n] in grams:
                    rows.append(grams[marked[i : i + n]])
                    lost += 5 - n
                    break
        return [(sum(r[k] for r in rows) - 0.4 * lost) / max(1, len(rows)) for k in range(len(langs))]

    scorer = langid.Scorer(langid.fit(docs))
    texts = [r.text for r in docs.collect() if len(r.text or "") < 5_000] + ["qwertz housing lumièrement Gärtner", "xq zvw", "licht river"]
    for text, (lang, score, fit) in zip(texts, scorer.judged(texts)):
        ws = split(text)
        if not ws:
            assert (lang, score, fit) == ("und", 0.0, None)
            continue
        total = [sum(x) for x in zip(*map(word, ws))]
        best = max(total)
        assert lang == langs[total.index(best)] or sorted(total)[-2] == pytest.approx(best, abs=1e-3)
        assert score == pytest.approx(1 / sum(math.exp(t - best) for t in total), abs=1e-3)
        blank = sum(not any(word(w)) for w in ws)
        assert fit == pytest.approx((best - 15 * blank) / len(ws) + 2 / math.sqrt(len(ws)), abs=1e-3)


def test_pieces_equal_the_merging_library(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    given = [r.text for r in docs.collect()] + ["a  b", "  lead and trail  ", "\x00\t\r\n", "<s> </s> <unk>", "𝔘nicode ñandú 漢字" * 50, "x" * 5_000, "▁▁ a ▁", "def f(a):\n        return a"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "doc_id long, text string")
    for r in pieces.encode_texts(frame).collect():
        text = given[r.doc_id] or ""
        assert r.ids == sp.encode(text) and r.n_tokens == len(r.ids)
        assert r.round_trip == ("▁" not in text)
    back = {r.doc_id: r.text for r in pieces.decode_ids(pieces.encode_texts(frame)).collect()}
    assert all(back[i] == (t or "").replace("▁", " ") for i, t in enumerate(given))


def test_pieces_unigram_path_is_cheapest():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = pieces.UNIGRAM, False
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.escape_whitespaces, proto.normalizer_spec.remove_extra_whitespaces = False, True, True
    scores = {"a": -3.0, "b": -3.5, "ab": -2.0, "abc": -9.0, "c": -1.0, "bc": -2.2, "▁": -1.5, "▁a": -4.0}
    for piece, score, kind in [("<unk>", 0, pieces.UNKNOWN), *((p, s, pieces.NORMAL) for p, s in scores.items())]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    t = pieces.PieceTransducer(proto.SerializeToString())

    def best(s):
        return max((scores[s[:n]] + best(s[n:]) for n in range(1, len(s) + 1) if s[:n] in scores), default=0.0 if not s else -math.inf)

    for text in ("abc", "ab abc c", "a  bcab", "cab"):
        ids = t.encode(text).tolist()
        assert sum(t.scores[i] for i in ids) == pytest.approx(best(text.replace("  ", " ").replace(" ", "▁")))
    assert t.encode("abXYc").tolist() == [t.ids["ab"], t.unknown, t.ids["c"]] and t.encode("").tolist() == []


def test_pieces_empty_table(no_docs):
    assert pieces.encode_texts(no_docs).count() == 0


def test_recurrent_model_gradients_and_carried_state():
    rng = np.random.default_rng(0)
    m = gru.Gru(3, 4, 3, 5, seed=1)
    m.p = {k: x.astype(np.float64) for k, x in m.p.items()}
    ids, targets, resets = rng.integers(0, 12, (6, 2)), rng.integers(0, 12, (6, 2)), np.zeros((6, 2), bool)
    resets[3, 1] = True

    def run(grads=None, keep=False):
        hs, _, kept = m.states(ids, resets, np.zeros((2, 5)), keep)
        got = m.log_probs(hs.reshape(-1, 5).astype(np.float64), targets.reshape(-1), grads)
        if grads is not None:
            m.backward(ids, resets, kept, got[1].reshape(6, 2, 5), grads)
        return -(got[0] if grads is not None else got).sum()

    grads = {k: np.zeros_like(x) for k, x in m.p.items()}
    run(grads, True)
    for k, x in m.p.items():
        at = np.unravel_index(rng.integers(x.size), x.shape)
        old, losses = x[at], []
        for d in (1e-2, -1e-2):
            x[at] = old + d
            losses.append(run())
        x[at] = old
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(grads[k][at], rel=1e-2, abs=1e-3)
    model = gru.Gru(3, 4, 3, 5)
    texts = [np.append(rng.integers(2, 12, n), gru.END) for n in (0, 1, 5, 33, 200)]
    plain = [gru.score(model, [t], steps=1_000)[0] for t in texts]
    assert gru.score(model, texts, most=2, steps=7) == pytest.approx(plain, rel=1e-5)
    assert sum(np.exp(gru.Gru(3, 4, 3, 5).log_probs(np.ones((12, 5), np.float32), np.arange(12)))) == pytest.approx(1, abs=1e-5)


def test_language_model_scores(spark, docs, no_docs):
    from tidekb.llm.common import crc_mod

    model = lmscore.fit(docs, crc_mod("doc_id", 7) != 2, classes=4, members=4, head=12)
    import zlib

    rows = docs.select("doc_id", "text").collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    counts = Counter()
    for r in rows:
        if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 != 2:
            counts.update([*split(r.text), "\n"])
    total, distinct = sum(counts.values()), len(counts)
    assert (model.total, model.distinct) == (total, distinct) and len(model.head) <= 12 < distinct
    got = lmscore.score_texts(docs, model).collect()
    assert len(got) == len(rows)
    want = Counter()
    for r in rows:
        ws = [*split(r.text), "\n"]
        want[r.doc_id, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), 5)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    vocabulary = [w for w in counts if w != "\n" and w.encode() not in model.words]
    shares = sum((counts[w] + 1) / model.others for w in vocabulary) + 1 / model.others
    assert shares == pytest.approx(1, abs=0.02 * len(vocabulary))
    untrained = lmscore.fit(no_docs, F.lit(True))
    assert {r.n_known for r in lmscore.score_texts(docs, untrained).collect()} == {0} and lmscore.score_texts(no_docs, untrained).count() == 0


def test_language_model_learns_from_every_training_document_once(spark, monkeypatch):
    seen = Counter()

    def learn(spark, docs, shape, words, weights, rate):
        seen.update(int(r.text.split()[0]) for r in docs.collect())
        return weights

    monkeypatch.setattr(lmscore, "_round", learn)
    text = F.concat(F.col("id").cast("string"), F.repeat(F.lit(" a b"), 400))
    many = spark.range(4_000).select(F.when(F.col("id") % 10 > 0, F.col("id")).alias("doc_id"), text.alias("text"))
    model = lmscore.fit(many, F.col("doc_id").isNull() | (F.col("doc_id") % 7 != 2))
    assert model.total > 2_000_000
    assert seen == Counter(i for i in range(4_000) if i % 10 == 0 or i % 7 != 2)


def test_training_lowers_held_out_surprise():
    rng = np.random.default_rng(3)

    def chain(n):
        out = [2]
        for _ in range(n):
            out.append(2 + (out[-1] - 2 + (1 if rng.random() < 0.9 else 3)) % 8)
        return np.append(out, gru.END)

    docs, held = [chain(60) for _ in range(80)], [chain(60) for _ in range(10)]
    model = gru.Gru(3, 4, 8, 12)
    before = gru.score(model, held).sum()
    opt = None
    for _ in range(8):
        opt = gru.train(model, docs, 0.02, opt=opt)
    assert gru.score(model, held).sum() > 0.6 * before
