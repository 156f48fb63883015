"""URL filter, joins, mixing, WARC and exact deduplication against plain restatements, with odd rows and empty tables."""

import base64
import gzip
import hashlib
import io
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidekb.llm import cluster, exactdedup, mixing, nearvec, ngramjoin, urlgraph, warc

PAGE = "page_id long, url string, html string"


def groups_of(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(7, 7), (500, 501), (501, 500)]
    got = {r.id: r.comp for r in cluster.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == groups_of(edges, {x for e in edges for x in e})
    assert cluster.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_exact_dedup(docs, no_docs):
    rows = docs.select("doc_id", "text").collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    by = defaultdict(list)
    for r in rows:
        by[norm(r.text)].append(r.doc_id)
    first = {t: min((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    for digest in (exactdedup.sha256, lambda t: F.substring(exactdedup.sha256(t), 1, 1)):  # the second one collides all the time
        got = exactdedup.exact_dedup(docs, digest=digest).collect()
        want = Counter((r.doc_id, first[norm(r.text)], len(by[norm(r.text)])) for r in rows)
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
        assert sum(r.kept for r in got) == len(by)
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got if r.doc_id not in (7, None))
    kept = exactdedup.keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len(by)
    assert exactdedup.exact_dedup(no_docs).count() == 0 and exactdedup.keep_first(no_docs).count() == 0


def test_exact_dedup_state_goes_on(spark, tmp_path):
    from tidekb.llm.common import located

    def prints(ids, name):
        at = str(tmp_path / name)
        docs = spark.createDataFrame([(i, f"text {i % 3}") for i in ids], "doc_id long, text string").repartition(2)
        docs.write.parquet(at)
        out = located(spark.read.parquet(at)).select(F.col("doc_id").alias("id"), "at_file", "at_row", F.octet_length("text").cast("long").alias("n_bytes"), exactdedup.sha256(F.col("text")).alias("digest"))
        out.write.mode("append").parquet(str(tmp_path / "prints"))
        return out.schema

    schema = prints(range(10, 20), "a")
    run = lambda: {r["first"]["id"]: r["n"] for r in exactdedup.first_seen(spark, str(tmp_path / "prints"), schema, 1, str(tmp_path / "state")).collect()}
    assert run() == {10: 4, 11: 3, 12: 3}
    prints(range(0, 6), "b")
    assert run() == {0: 5, 1: 6, 2: 5}


def test_ngram_join_against_all_pairs(docs, no_docs):
    rows = docs.select("doc_id", "text").collect()
    cut = ngramjoin.Shingler(5)
    sets = [set(cut.grams(r.text).tolist()) for r in rows]
    pairs = [(a, b) for a, b in combinations(range(len(rows)), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    links, group = Counter(x for p in pairs for x in p), groups_of(pairs, range(len(rows)))
    low = defaultdict(list)
    for i, g in group.items():
        low[g].append(rows[i].doc_id)
    name = {g: min((k for k in ids if k is not None), default=None) for g, ids in low.items()}
    for block in (1_000, 2):  # in one block, and dealt over block pairs
        got = ngramjoin.ngram_join(docs, block_rows=block).collect()
        assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == Counter((r.doc_id, name[group[i]], links[i]) for i, r in enumerate(rows))
        assert sum(r.kept for r in got) == len(low)
    kept = ngramjoin.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(low)
    assert ngramjoin.ngram_join(no_docs).count() == 0


def test_ngram_join_of_a_large_group(spark):
    """A third of the rows are near copies of one text: links between all of them, over many blocks."""
    import random

    rng = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(w if rng.random() > 0.008 else f"x{rng.random()}" for w in base) if i % 3 == 0 else " ".join(f"q{rng.randrange(9999)}" for _ in range(80))) for i in range(450)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    cut = ngramjoin.Shingler(5)
    sets = {i: set(cut.grams(t).tolist()) for i, t in rows}
    pairs = [(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = {r.doc_id: r for r in ngramjoin.ngram_join(frame, block_rows=40).collect()}
    links, group = Counter(x for p in pairs for x in p), groups_of(pairs, sets)
    assert {i: r.n_links for i, r in got.items()} == {i: links[i] for i in sets}
    assert {i: r.class_id for i, r in got.items()} == group


def test_banding_reaches_its_recall():
    bands, rows = ngramjoin.bands_for(0.8, 0.99)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99 and bands * rows <= 256
    rng = np.random.default_rng(0)
    found = 0
    for _ in range(300):
        both, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (80, 10, 10))
        mh = ngramjoin.MinHasher(bands, rows, 1)
        found += (mh.band_hashes(np.concatenate([both, a])) == mh.band_hashes(np.concatenate([both, b]))).any()
    assert found >= 0.97 * 300


def vectors(n=300, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    x[1::3] = x[0] + 0.05 * rng.standard_normal((len(x[1::3]), dim))
    x[50] = 7 * x[51]
    rows = [(i, [float(v) for v in np.float32(r)], 1) for i, r in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * dim, 1), (902, [float("nan")] + [1.0] * (dim - 1), 1), (903, [float("inf")] + [1.0] * (dim - 1), 1), (904, [], 1), (905, [1.0, 2.0], 1), (906, [1.0, 2.0], None)]
    return [*rows, rows[2], rows[2], (None, rows[2][1], 1), (907, [None] + [1.0] * (dim - 1), 1)]


@pytest.mark.parametrize(("kind", "block"), [("float", 1_000), ("double", 30)])
def test_vector_links_against_all_pairs(spark, kind, block):
    rows = vectors()
    got = nearvec.vector_links(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n_links int"), block_rows=block).collect()
    real = [i for i, (k, v, _) in enumerate(rows) if k is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    unit = {i: np.array(rows[i][1]) / np.linalg.norm(rows[i][1]) for i in real}
    pairs = [(a, b) for a, b in combinations(real, 2) if len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    links, group = Counter(x for p in pairs for x in p), groups_of(pairs, range(len(rows)))
    low = defaultdict(list)
    for i, g in group.items():
        low[g].append(rows[i][0])
    want = Counter((r[0], links[i], min((k for k in low[group[i]] if k is not None), default=None)) for i, r in enumerate(rows))
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_vector_links_empty_table_and_tables(spark):
    assert nearvec.vector_links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert nearvec.vector_links(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).count() == 1
    tables, projections = nearvec.tables_for(50_000)
    assert 1 - (1 - nearvec.meeting(0.2**0.5, nearvec.WIDTH) ** projections) ** tables >= nearvec.RECALL


def test_water_fill():
    assert mixing.water_fill({"a": 90, "b": 10}, {"a": 1, "b": 3}, 3) == {"a": 70.0, "b": 30.0}
    out = mixing.water_fill({"a": 1000, "b": 1, "c": 10, "d": 0}, {"a": 1, "b": 2, "c": 3, "d": 1}, 3)
    assert out == {"a": 978.0 - 10 + 10, "b": 3.0, "c": 30.0, "d": 0.0}


def test_cheapest_flow_against_all_choices():
    """Two overlapping sources: the flow meets the quotas and no cheaper integer routing does."""
    supply, links, quotas = [3, 2, 2], [[0], [1], [0, 1]], [5, 4]
    got = mixing.cheapest_flow(supply, links, quotas, 2)
    cost = lambda f, s: max(0, f - s)
    best = min(sum(cost(f, s) for f, s in zip((a, b, c0 + c1), supply)) for a in range(7) for b in range(5) for c0 in range(5) for c1 in range(5 - c0) if a + c0 == 5 and b + c1 == 4)
    assert sum(got) == 9 and all(f <= 2 * s for f, s in zip(got, supply)) and sum(cost(f, s) for f, s in zip(got, supply)) == best


def test_mixing(docs, no_docs):
    sized = mixing.sized(docs.drop("size", "taken"))
    rows = mixing.mix_to_targets(sized, "members", bucket_rows=8).collect()
    assert len(rows) == docs.count()
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows)
    size, taken, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        target[r["source"]] = r["target_sum"]
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
    assert target == mixing.water_fill(size, mixing.cycling_weights(list(size)), 3)
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in size)
    again = mixing.mix_to_targets(sized.repartition(5), "members", bucket_rows=1_000).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in rows) == Counter((r["doc_id"], r["size"], r["taken"]) for r in again)
    assert mixing.mix_to_targets(mixing.sized(no_docs), "members").count() == 0


def test_mixing_keeps_columns_of_any_name(docs):
    """Columns named like those that the plan uses inside pass through; those named like outputs are replaced."""
    plain = mixing.sized(docs.select("doc_id", "text", "source"))
    want = sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in mixing.mix_to_targets(plain, "members", bucket_rows=8).collect())
    names = ["rest", "times", "width", "before", "_h", "_p", "_pattern", "_more", "_inside", "edge_bucket", "key"]
    clash = plain.withColumns({n: F.lit(f"own {n}") for n in names} | {"taken": F.lit("x"), "target_sum": F.lit("x")})
    got = mixing.mix_to_targets(clash, "members", bucket_rows=8)
    assert sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in got.collect()) == want
    assert all(r[n] == f"own {n}" for r in got.collect() for n in names)


def test_repeated_rows_follow_the_mix(docs, no_docs):
    """Texts as often as the mix takes them, with all their columns; the thin mix and the texts agree row by row."""
    from collections import Counter

    got = mixing.repeat_to_targets(docs, bucket_rows=8)
    assert got.columns == docs.columns
    mixed = mixing.mix_to_targets(mixing.sized(docs.drop("size", "taken")), "members", bucket_rows=8)
    want = Counter()
    for r in mixed.filter("size > 0").collect():
        want[(r["doc_id"], r["text"])] += r["taken"] // r["size"]
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == +want
    assert mixing.repeat_to_targets(no_docs).count() == 0


def test_mixing_of_overlapping_sources(spark):
    rows = [(i, 10, m) for i, m in enumerate([["a"]] * 30 + [["a", "b"]] * 30 + [["b"]] * 5 + [["c", None]] * 5 + [[]] * 3)]
    got = mixing.mix_to_targets(spark.createDataFrame(rows, "doc_id long, size long, members array<string>"), "members").collect()
    assert all(r["taken"] == 0 for r in got if not r["members"]) and all(r["taken"] <= 30 for r in got)
    assert sum(r["taken"] for r in got) == 650  # of 700: the five documents of the last two sources can't fill both quotas
    with pytest.raises(ValueError):
        mixing.mix_to_targets(spark.createDataFrame(rows, "doc_id long, size long, members array<string>"), "members", max_patterns=2)


def test_url_rules_and_hosts(spark):
    urls = ["http://Example.COM/en/x?q#f", "https://www.example.com/en/", "http://www.example.com/fr", "http://a.example.com/en/", "http://x.net/es/1", "http://y.net/es", "http://net/fr/", "http://dotnet/fr/", "http://foo.org", None, "no scheme/com/", "", "http://com", "a://b://c/d", "ftp://É.com/"]
    got = {r.page_id: r for r in urlgraph.judge_urls(spark.createDataFrame(list(enumerate([[u, None] for u in urls])), "page_id long, x array<string>").select("page_id", F.col("x")[0].alias("url"), F.col("x")[1].alias("html"))).collect()}
    for i, url in enumerate(urls):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in urlgraph.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, *best[1:])


def test_trust_spreads_over_links(spark):
    link = lambda *hosts: "".join(f'<p><A class=x HREF = "//{h}/p?q">t</a><a href="/own">o</a>' for h in hosts)
    pages = [(1, "http://good.com/", link("friend.org", "friend.org", "near.org")), (2, "http://bad.net/es/", link("spam.org")), (3, "http://farm.org/", link("bad.net", "bad.net")), (4, "http://friend.org/a", link("second.org")), (5, "http://farm2.org/", link("farm.org")), (6, "http://second.org/", None), (7, "http://lone.org/", "<a href='http://lone.org/x'>"), (8, "http://spam.org/", "")]
    got = {r.host: r for r in urlgraph.judge_urls(spark.createDataFrame(pages, PAGE)).collect()}
    assert {h: r.verdict for h, r in got.items()} == {"good.com": "allow", "bad.net": "block", "farm.org": "block", "friend.org": "allow", "farm2.org": "block", "second.org": "allow", "lone.org": "allow", "spam.org": "allow"}
    hosts = ["good.com", "friend.org", "near.org", "second.org"]
    step = np.zeros((4, 4))
    step[1, 0], step[2, 0], step[3, 1] = 2 / 3, 1 / 3, 1
    start = np.array([1.0, 0, 0, 0])
    score = start
    for _ in range(urlgraph.ROUNDS):
        score = 0.15 * start + 0.85 * step @ score
    assert [got[h].trust for h in hosts if h in got] == pytest.approx([s for h, s in zip(hosts, score) if h in got])
    assert urlgraph.judge_urls(spark.createDataFrame([], PAGE)).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b\r\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "x" * 2_000_000), (5, "http://e", "x" * 2_000_000), (None, "http://f", "<p>é</p>"), (6, "http://g", "\r\n\r\nWARC/1.1\r\n")]
    manifest = warc.write_archives(spark.createDataFrame(rows, PAGE).withColumn("payload", F.lit(1)).repartition(3), archive_bytes=2_000)
    got = warc.read_archives(manifest).collect()
    want = Counter()
    for k, _, html in rows:
        body = (html or "").encode()
        last = max(i for i, _, h in rows if (h or "") == (html or "") and i is not None)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        want[None if k is None else str(k), len(body), digest, "response" if k == last else "revisit", None if k == last else str(last), body if k == last else None] += 1
    assert Counter((r.page, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got) == want
    small = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, PAGE), least=10), False).collect()
    assert Counter((r.record_type, r.payload_bytes) for r in small)["response", 0] == 2
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], PAGE))).count() == 0


def test_warc_reader_rejects_broken_archives():
    good = warc.record("response", "1", "http://a", b"abc", 3, warc.base32(hashlib.sha1(b"abc").digest()), None, "2024-01-01T00:00:00Z")
    read = lambda data: [warc.http_payload(*r) for r in warc.records(io.BytesIO(data))]
    assert read(gzip.compress(good) + gzip.compress(good)) == [(3, b"abc")] * 2 and read(b"") == []
    for data in (gzip.compress(good)[:-9], gzip.compress(good[:-1]), gzip.compress(good + b"x"), gzip.compress(good.replace(b"abc", b"abd")), gzip.compress(good[4:]), b"no gzip"):
        with pytest.raises(warc.WarcError):
            read(data)
