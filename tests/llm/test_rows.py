"""Operators on pages, vectors, fingerprints and labels against plain Python."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyhive.llm import components, quality, simhash, topk, warc
from skyhive.llm.common import fresh_path

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("payload", T.StringType())])


def test_warc_round_trip(llm_spark):
    long, other = "<p>é" * 400, "<q>" * 400
    pages = [(1, "http://a/ b%c", long, "x"), (5, None, long, "x"), (3, "u\r\nv", long, "x"), (2, "u", "short", "x"), (9, "u", "short", "x"), (4, "u", None, "x"),
             (6, "u", "", None), (None, "u", long, "x"), (8, "u", other, "x"), (8, "u", other, "x"), (-7, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 100, "x")]
    path = fresh_path(llm_spark, "warc")
    warc.write_warc(warc.captured(llm_spark.createDataFrame(pages, PAGES).repartition(3)), path)
    back = warc.read_warc(llm_spark, path).where("record_type in ('response', 'revisit')")
    rows = back.collect()
    keeper = {}
    for i, _, h, _ in pages:
        if i is not None and len((h or "").encode()) >= 1000:
            keeper[h] = max(keeper.get(h, i), i)
    wanted = []
    for i, u, h, _ in pages:
        h = h or ""
        again = h in keeper and i != keeper[h]
        wanted.append((i, u, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "revisit" if again else "response", keeper[h] if again else None, None if again else h.encode()))
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [(r.record_key, r.target_uri, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in rows]
    assert sorted(got, key=key) == sorted(wanted, key=key)
    only = warc.read_warc(llm_spark, path, payload="false").where("record_type = 'response' and payload_bytes < 10")
    assert sorted((r.payload_bytes, r.payload) for r in only.collect()) == [(0, None), (0, None), (5, None), (5, None)]
    none = fresh_path(llm_spark, "warc")
    warc.write_warc(warc.captured(llm_spark.createDataFrame([], PAGES)), none)
    assert warc.read_warc(llm_spark, none).where("record_type = 'response'").count() == 0


def test_warc_is_plain_gzip_and_reads_foreign_archives(tmp_path):
    import gzip
    import io

    row = {"record_type": "response", "record_key": 3, "refers_to": None, "target_uri": "u", "payload_bytes": 4, "payload_digest": "d", "payload": b"page"}
    text = gzip.decompress(warc.page_record(row))
    assert text.startswith(b"WARC/1.1\r\n") and b"\r\n\r\npage\r\n\r\n" in text
    foreign = gzip.compress(text) + gzip.compress(text.replace(b"page", b"eggs"))
    found = [(h["warc-type"], p) for h, p in warc.records(io.BytesIO(foreign), 0, None, lambda h: True, True)]
    assert found == [("response", b"page"), ("response", b"eggs")]
    skipped = [p for _, p in warc.records(io.BytesIO(warc.page_record(row) * 2), 0, None, lambda h: True, False)]
    assert skipped == [None, None]


def test_top_k_against_all_products(llm_spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(0, 700)]
    vectors += [(750, None), (None, [1.0] * 6), (800, [float("nan")] * 6), (850, [1.0, None]), (900, [float("inf")]), (950, []), (1000, [2.0]), (50, [3.0] * 6), (1050, [1e6] * 6), (1050, [1e6] * 6)]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("rank", T.StringType())])
    table = llm_spark.createDataFrame([(*v, "x") for v in vectors], schema).repartition(4)
    sound = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    wanted = []
    for a, (q, u) in enumerate(sound):
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(u, v)), i) for b, (i, v) in enumerate(sound) if b != a)[:5]
            wanted += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    found = topk.top_k(table, shard=64).collect()
    assert sorted(tuple(r) for r in found) == sorted(wanted)
    assert topk.top_k(table.limit(0)).count() == 0


def test_anchors_cover():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 32, 500, dtype=np.uint32)
    y = x ^ (np.uint32(1) << rng.integers(0, 32, 500).astype(np.uint32))
    i, a, home = simhash.anchors(x)
    at_home = dict(zip(i[home].tolist(), a[home].tolist()))
    j, b, _ = simhash.anchors(y)
    seen = {}
    for p, q in zip(j.tolist(), b.tolist()):
        seen.setdefault(p, set()).add(q)
    assert all(at_home[k] in seen[k] for k in range(500)) and max(map(len, seen.values())) == 17


def groups(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("crowd", [3, 2048])
def test_links_join_all_near_fingerprints(llm_spark, crowd):
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for base in prints[:3]:  # crowded places
        prints += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(120)]
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = llm_spark.createDataFrame(list(enumerate(signed)), "node long, print long").select("node", F.unhex(F.lpad(F.hex("print"), 16, "0")).alias("blocks"), "print")
    wanted = groups(range(len(prints)), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    roots = components.components(simhash.links(nodes, 2, ["print"], 3, crowd))
    found = dict(enumerate(range(len(prints)))) | {r["node"]: r["root"] for r in roots.collect()}
    assert found == wanted
    wide = nodes.select("node", "blocks", "print", F.lit(0).cast("long").alias("more"))
    again = components.components(simhash.links(wide, 2, ["print", "more"], 3, crowd))
    assert dict(enumerate(range(len(prints)))) | {r["node"]: r["root"] for r in again.collect()} == wanted


def test_components_of_a_chain_and_a_star(llm_spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 300)] + [(7, 7), (None, 3), (500, 400)]
    found = {r["node"]: r["root"] for r in components.components(llm_spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 300)} | {500: 400}
    assert components.components(llm_spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(llm_spark, corpus, nothing):
    rows, docs = corpus

    def fingerprint(t):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(t) for _, t in rows]
    known = [k for k, (i, _) in enumerate(rows) if i is not None]
    links = [(rows[a][0], rows[b][0]) for a in known for b in known if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    # two rows of one id are two documents: link by row, name by id
    by_row = groups(known, [(a, b) for a in known for b in known if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    least = {}
    for k in known:
        least[by_row[k]] = min(least.get(by_row[k], rows[k][0]), rows[k][0])
    wanted = [(i, p, least[by_row[k]] if i is not None else None) for k, ((i, _), p) in enumerate(zip(rows, prints))]
    found = [(r["doc_id"], r["print"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert links and sorted(found, key=key) == sorted(wanted, key=key)
    assert simhash.near_duplicates(nothing).count() == 0


def test_one_of_each_group_stays(llm_spark, corpus, nothing):
    rows, docs = corpus

    def shingles(t):
        w = (t or "").encode().lower().split()
        return {b" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (not sets[a] and not sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0]
    label = groups(range(len(rows)), links)
    kept = simhash.without_copies(docs)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert len(found) == len(set(label.values())) < len(rows)
    place = {}
    for k, r in enumerate(rows):
        place.setdefault(r, []).append(k)
    assert sorted(label[place[f][0]] for f in found) == sorted(set(label.values()))
    assert simhash.without_copies(nothing).count() == 0


def test_near_copies_are_found_by_fingerprints_before_bands(llm_spark, monkeypatch):
    """Without any shared band the SimHash links alone join texts a few bits apart; the set check still refuses others."""
    rng = random.Random(5)
    base = ["w%d" % rng.randrange(3000) for _ in range(600)]
    near = base[:300] + ["changed"] + base[301:]
    far = ["v%d" % rng.randrange(3000) for _ in range(600)]
    prints = [int.from_bytes(simhash.fingerprint(simhash.shingle_hashes(" ".join(t).encode(), 3)).tobytes()) for t in (base, near, far)]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 < (prints[0] ^ prints[2]).bit_count()
    nodes = llm_spark.createDataFrame([(i, 1, bytes(256), p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "node long, size long, bands binary, print long")
    found = simhash.links_of_prints(nodes.select("node", "print")).collect()
    assert {tuple(sorted((r.a, r.b))) for r in found} == {(0, 1)}
    monkeypatch.setattr(simhash, "_banded", lambda batches: (b.select([]).from_arrays([b.column("node"), b.column("node")], names=["key", "node"]) for b in batches))
    assert stays(llm_spark, [" ".join(t) for t in (base, near, far)]) == 2


def stays(spark, texts):
    return simhash.without_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count()


@pytest.mark.parametrize("edit", ["appended", "repeated", "cut", "block"])
def test_edits_in_one_place_are_found_at_the_threshold(llm_spark, edit):
    rng, texts, pairs = random.Random(11), [], 60
    word = lambda: "w%d" % rng.randrange(3000)
    for k in range(pairs):
        n = rng.choice([80, 120, 400] if edit == "block" else [40, 120, 400])
        base = [word() for _ in range(n)]
        m = (n - 4) // 4 - 1 if edit == "appended" else (n - 4) // 5 - 1 if edit == "cut" else (n - 4) // 9 - 5
        if edit == "appended":
            other = base + [word() for _ in range(m)]
        elif edit == "repeated":  # one word as often as half the text: weighs in counts, hardly in the set
            other = base + ["again"] * (n // 2)
        elif edit == "cut":
            other = base[:-m]
        else:
            other = base[:n // 2] + [word() for _ in range(m)] + base[n // 2 + m:]
        a, b = ({tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in (base, other))
        assert len(a & b) >= 0.8 * len(a | b)
        texts += [" ".join(base), " ".join(other)]
    assert stays(llm_spark, texts) == pairs


@pytest.mark.parametrize("part", [1024, 50])
@pytest.mark.parametrize("appended", [22, 26])
def test_links_within_a_shared_template_are_all_checked(llm_spark, monkeypatch, appended, part):
    monkeypatch.setattr(simhash.links_of_sets, "__defaults__", (part,))
    rng = random.Random(3)
    base = ["b%d" % i for i in range(200)]
    texts = [base] + [base + ["x%d" % rng.randrange(10 ** 6) for _ in range(2 * rng.randint(appended - 9, appended))] for _ in range(200)]
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert stays(llm_spark, [" ".join(t) for t in texts[::-1]]) == len(set(groups(range(len(sets)), links).values()))


def test_quality_learns_held_out_labels(llm_spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        body = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        low, toxic = i % 5 == 0, i % 7 == 3
        if low:
            body = [w.upper() + "!!" for w in body]
        if toxic:
            for _ in range(5):
                body[rng.randrange(len(body))] = rng.choice(["zzbad", "zzworse", "zzworst"])
        rows.append((i, " ".join(body), "en", f"site{i % 4}", bool(low or toxic)))
        if i < 400:
            labels.append((i, int(not low), int(toxic)))
    docs = llm_spark.createDataFrame(rows + [(None, None, None, None, None), (1000, "", "en", "site1", None)], "doc_id long, text string, lang string, source string, keep boolean")
    known = llm_spark.createDataFrame(labels + [(5, None, 1), (None, 0, 1), (99_999, 0, 1)], "doc_id long, quality int, toxic int")
    judged = quality.judged(docs, known).select("doc.doc_id", F.col("doc.keep").alias("bad"), "p_low", "p_toxic", "keep").collect()
    held = [r for r in judged if r["doc_id"] is not None and 400 <= r["doc_id"] < 600]
    assert sum(r["keep"] == (not r["bad"]) for r in held) >= 0.97 * len(held)
    assert len(judged) == 602 and all(0 <= r["p_low"] <= 1 and 0 <= r["p_toxic"] <= 1 for r in judged)
    kept = quality.kept(docs, known)
    assert kept.columns == docs.columns
    assert quality.kept(docs, known.limit(0)).count() == 602
    assert quality.kept(docs.limit(0), known).count() == 0


def test_sparse_sites_keep_their_parents_rate(llm_spark):
    rows = [("a", "en", 0.9)] * 300 + [("b", "en", 0.05)] * 300 + [("c", "en", 0.9)] + [("", "", 0.1)] * 20
    rates = {(r["source"], r["lang"]): r["rate_low"] for r in quality.site_rates(llm_spark.createDataFrame(rows, "source string, lang string, p_low double"), {"low": 0.3}).collect()}
    assert rates["a", "en"] > 0.85 and rates["b", "en"] < 0.1 and 0.2 < rates["c", "en"] < 0.8


def test_quality_does_not_follow_the_layout_of_rows(llm_spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (llm_spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "labels"))
    found = []
    for parts, order in ((3, "doc_id"), (7, "text")):
        rows = quality.judged(docs.orderBy(F.desc(order)).repartition(parts), labels.repartition(parts)).select("doc.doc_id", "p_low", "p_toxic", "keep").orderBy("doc_id").collect()
        found.append(rows)
    assert [(r["doc_id"], r["keep"]) for r in found[0]] == [(r["doc_id"], r["keep"]) for r in found[1]]
    assert all(abs(a[c] - b[c]) < 1e-9 for a, b in zip(*found) for c in ("p_low", "p_toxic"))
