"""Operators 11 to 13 against plain Python: dense eigenvectors, counted phrases, the tiktoken library."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest

from skyhive.llm import byte_merges, phrases, whitening

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_merges.load_ranks(RANKS), special_tokens={})


def test_byte_merges_as_tiktoken(llm_spark, corpus, nothing, tiktoken_encoding):
    rows, docs = corpus
    tokens = byte_merges.encode(docs, RANKS, public_tokenizers.PATTERN)
    found = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_merges.digests(tokens, RANKS).collect())
    sha = lambda data: hashlib.sha256(data).hexdigest()
    ids = [(i, tiktoken_encoding.encode_ordinary(t or ""), t or "") for i, t in rows]
    assert found == collections.Counter((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(t.encode())) for i, x, t in ids)
    decoded = collections.Counter((r["doc_id"], bytes(r["decoded"])) for r in byte_merges.decode(tokens, RANKS).collect())
    assert decoded == collections.Counter((i, (t or "").encode()) for i, t in rows)
    assert byte_merges.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_fold_of_higher_order_functions(llm_spark, tiktoken_encoding):
    words = [" the", "unbelievable", "Zürich", "aaaaaaa", "\x00\xff", "日本", " qzxvw9", "1234567", ""]
    found = byte_merges.encode_words(llm_spark.createDataFrame([(w.encode(),) for w in words] * 2 + [(None,)], "word binary"), RANKS).collect()
    assert {bytes(r["word"]): list(r["ids"]) for r in found} == {w.encode(): tiktoken_encoding._core_bpe.encode_single_piece(w.encode()) if w else [] for w in words}


def test_heap_merges_in_the_fold_s_order():
    words = byte_merges.vocabulary(RANKS)
    for text in ("abcab" * 50, "x" * 301, "theintheandthe" * 20, "éß日本" * 30):
        ids = [words.single[b] for b in text.encode()]
        assert words.by_heap(list(ids)) == words.folded(list(ids))


def counted(rows, minimum):
    """Exact counts, scores and drops of phrases in plain Python."""
    f = collections.Counter()
    for lang, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = re.findall("[^ \t]+", piece)
            for k in range(1, 5):
                f.update((lang or "und", tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    n = collections.Counter()
    for (lang, w), a in f.items():
        n[lang] += a if len(w) == 1 else 0
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= minimum}
    out = []
    for (lang, w), a in candidates.items():
        inside = lambda v: any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))
        if any(lang == x and len(v) > len(w) and inside(v) and 100 * b >= 80 * a for (x, v), b in candidates.items()):
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]], n[lang]))
    ranks = collections.Counter()
    for lang, score, a, phrase, left, right, total in sorted(out):
        ranks[lang] += 1
        yield (lang, ranks[lang], phrase.decode(), -a, left, right, total, -score)


def as_rows(df):
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("every", [1, 3, 40])
def test_phrases_are_exact_whatever_the_sample(llm_spark, corpus, every):
    rows, docs = corpus
    langs = [(None if r["lang"] is None else r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    minimum = 6
    assert as_rows(phrases.collocations(docs, minimum, 10_000, every)) == sorted(counted(langs, minimum))
    _, failures = phrases.frequent(docs, minimum, every)
    assert (failures == 0) == (every == 1)


def test_phrases_ties_limits_and_empty(llm_spark, nothing):
    docs = llm_spark.createDataFrame([(i, "B a, b A; c\x0bd a b", "x", 1) for i in range(5)] + [(None, None, None, 1)], "doc_id long, text string, lang string, score int")
    assert as_rows(phrases.collocations(docs, 5, 3, 2)) == sorted(counted([("x", "B a, b A; c\x0bd a b")] * 5, 5))[:3]
    assert phrases.collocations(nothing).count() == 0


def test_parts_cut_long_texts_where_pieces_end(llm_spark):
    import pyarrow as pa

    text = "one two, three four five. six seven eight; nine ten " * 40
    batch = pa.RecordBatch.from_pylist([{"lang": "en", "text": text}, {"lang": "de", "text": ""}, {"lang": "de", "text": "two three"}])
    def all_of(flush):
        f = collections.Counter()
        for part in phrases.parts([batch], flush):
            for n in (1, 2, 3):
                for r in part.counted(n, part.fits[n]).to_pylist():
                    f[r["lang"], r["phrase"]] += r["a"]
        return f
    assert all_of(100) == all_of(1 << 20) and all_of(100)["en", "three four five"] == 40 and ("en", "two three") not in all_of(100)


def vectors():
    draw = np.random.default_rng(3)
    base = (draw.standard_normal((300, 24)) * np.linspace(3, 0.5, 24)).round(3)
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(base)] + [(7, base[9].tolist(), ""), (None, base[9].tolist(), "")]
    bad = [(900, None, ""), (901, [], ""), (902, [1.0] * 23, ""), (903, [float("nan")] + [0.0] * 23, ""), (904, [None] + [0.0] * 23, ""), (905, [float("inf")] * 24, "")]
    return rows, bad


def test_whitening_against_dense_eigenvectors(llm_spark):
    rows, bad = vectors()
    found = whitening.whiten(llm_spark.createDataFrame(rows + bad, "id long, vector array<double>, n string"), wanted=4).collect()
    x = np.floor(64 * np.array([v for _, v, _ in rows])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    value, vector = value[::-1][:4], vector[:, ::-1][:, :4]
    want = (n * x - s) / n @ vector / np.sqrt(value)
    got = {}
    for r in found:
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    assert len(found) == 4 * len(rows) and {r["n"] for r in found} == {n}
    sign = np.sign([got[0, int(((n * x[0] - s) ** 2).sum())][k + 1][0]["whitened"] * want[0, k] for k in range(4)])
    for (i, _, _), v, w in zip(rows, x, want):
        here = got[i, int(((n * v - s) ** 2).sum())]
        for k in range(4):
            assert abs(here[k + 1][0]["whitened"] * sign[k] - w[k]) < 1e-9
            assert abs(here[k + 1][0]["explained"] - value[k] / (c * c).sum() * n) < 1e-9 and here[k + 1][0]["identity_error"] < 1e-9


def test_whitening_of_few_or_no_vectors(llm_spark):
    _, bad = vectors()
    make = lambda rows: whitening.whiten(llm_spark.createDataFrame(rows, "id long, vector array<double>, n string"))
    assert make([bad[0], bad[1]]).count() == 0
    assert make([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")]).count() == 0  # one distinct vector has no spread
    line = make([(i, [i / 64, 2 * i / 64, 0.0], "") for i in range(9)]).collect()  # one direction only
    assert {r["component"] for r in line} == {1} and len(line) == 9 and all(abs(r["explained"] - 1) < 1e-9 for r in line)


def test_queries_return_the_columns_asked_for(llm_spark):
    sf = "/root/testdata/sf0.001"
    assert whitening.op11_whitening(llm_spark, sf).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert phrases.op12_phrases(llm_spark, sf).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert byte_merges.op13_byte_bpe(llm_spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
