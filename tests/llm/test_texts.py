"""Operators on whole texts against plain Python on a small corpus with every odd case."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skyhive.llm import fingerprint, hmm, packing, sentencepiece, substrings, token_ids
from skyhive.llm.common import fresh_path

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def same_rows(found, wanted):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(found, key=key) == sorted(wanted, key=key)


def test_token_files_round_trip(llm_spark, corpus, nothing, ids_of):
    rows, docs = corpus
    path = fresh_path(llm_spark, "ids")
    token_ids.write_ids(docs, path, BPE, end_id=0)
    back = token_ids.read_ids(llm_spark, path).collect()
    wanted, before = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        ids = ids_of(t) + [0]
        wanted.append((i, before, len(ids), ids))
        before += len(ids)
    same_rows([(r["doc_id"], r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) for r in back], wanted)
    empty = fresh_path(llm_spark, "ids")
    token_ids.write_ids(nothing, empty, BPE)
    assert token_ids.read_ids(llm_spark, empty).count() == 0


def test_coder_starts_at_any_checkpoint_and_sees_damage():
    rng = np.random.default_rng(1)
    blocks = [np.minimum(rng.geometric(0.05, n), 300).astype(np.int32) for n in (0, 1, 63, 64, 65, 8192, 8193, 40_000)]
    freq, bits = token_ids.normalised(np.bincount(np.concatenate(blocks), minlength=400))
    assert freq.sum() == 1 << bits and ((freq > 0) == (np.bincount(np.concatenate(blocks), minlength=400) > 0)).all()
    coder = token_ids.Coder(freq)
    coded = [(*c, len(b)) for c, b in zip(coder.encode(blocks), blocks)]
    for a, b in zip(coder.decode(coded), blocks):
        assert a.tolist() == b.tolist()
    payload = bytearray(coded[-1][0])
    payload[-1] ^= 1
    with pytest.raises(ValueError):  # damage before the last segment shows in the block's CRC
        coder.decode([(bytes(payload), *coded[-1][1:])])


def test_packing_keeps_every_id_once(llm_spark, corpus, nothing, ids_of):
    rows, docs = corpus
    found = packing.pack(docs, BPE).collect()
    pieces = collections.defaultdict(list)
    sequences = collections.defaultdict(list)
    for r in found:
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    wanted = collections.defaultdict(list)
    for i, t in rows:
        ids = np.array(ids_of(t) + [1], "<u4")
        for s in range(0, len(ids), 2048):
            wanted[i, len(ids)].append((s, len(ids[s:s + 2048]), zlib.crc32(ids[s:s + 2048].tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in wanted.items()}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(nothing, BPE).count() == 0


def test_column_generation_fills_sequences():
    rng = np.random.default_rng(2)
    demand = np.bincount(np.minimum(64, np.ceil(rng.lognormal(2.5, 1, 50_000)).astype(int)), minlength=65)[1:]
    patterns = packing.solve(demand)
    sizes = np.arange(1, 65)
    given = sum(p * k for p, k in patterns)
    assert (given >= demand).all() and all((p * sizes).sum() <= 64 for p, _ in patterns)
    assert (demand * sizes).sum() / (64 * sum(k for _, k in patterns)) > 0.99
    brute = max((3 * a + 5 * b, a, b) for a in range(4) for b in range(3) if 2 * a + 3 * b <= 7)
    assert packing.best_pattern(np.array([0, 3, 5, 0, 0, 0, 0]))[0] == brute[0]


def test_substrings_against_all_windows(llm_spark, corpus, nothing):
    rows, docs = corpus
    words = [WORD.findall((t or "").encode()) for _, t in rows]
    seen = collections.Counter(tuple(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    wanted = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k:k + 35])] > 1:
                gone.update(range(k, k + 35))
        wanted.append((i, b" ".join(x for k, x in enumerate(w) if k not in gone).decode(), len(w), len(gone)))
    found = substrings.remove_repeats(docs)
    same_rows([(r["doc_id"], r["kept"], r["n_words"], r["n_removed"]) for r in found.collect()], wanted)
    assert found.schema["rest"].dataType.fieldNames() == [c for c in docs.columns if c not in ("doc_id", "text")]
    assert sum(w[3] for w in wanted) > 0
    assert substrings.remove_repeats(nothing).count() == 0


def test_cover_holds_every_difference():
    pairs = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert pairs == set(range(substrings.PERIOD))


def test_fingerprints_against_sets(llm_spark, corpus, nothing):
    rows, docs = corpus

    def pieces(t):
        out = set()
        for line in t.split("\n"):
            at, width = 0, fingerprint.PIECE
            while at < len(line):
                out.add(line[at:at + width])
                at, width = at + width, 2 * width
        return out

    def like(a, b):
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    found = fingerprint.compared(docs).collect()
    # the order of rows of one id is by hash; take the successor from the texts that may follow
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0]))
    unique = [k for k in range(len(ordered)) if sum(o[0] == ordered[k][0] for o in ordered) == 1 and sum(o[0] == ordered[(k + 1) % len(ordered)][0] for o in ordered) == 1]
    by_id = {r["doc_id"]: r for r in found}
    for k in unique:
        (i, t), (_, n) = ordered[k], ordered[(k + 1) % len(ordered)]
        edited = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        r = by_id[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - like(pieces(t), pieces(edited))) < 1e-9 and abs(r["near_next"] - like(pieces(t), pieces(n))) < 1e-9
    assert len(found) == len(rows) and len(unique) > 50
    assert fingerprint.compared(nothing).count() == 0
    one = fingerprint.compared(docs.where("text like 'one%'")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_hmm_base_and_likelihood(llm_spark, corpus, nothing):
    rows, docs = corpus
    tokens = [[w for w in WORD.findall((t or "").encode().lower())] + [b"\n"] for _, t in rows]
    out = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in rows]
    count = collections.Counter(w for t, o in zip(tokens, out) if not o for w in t)
    total = sum(count.values())
    wanted = sorted((-1 if i is None else i, o, len(t), sum(count[w] > 0 for w in t), total,
                     sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in t)) for (i, _), t, o in zip(rows, tokens, out))
    found = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in hmm.scored(docs, hmm.held_out_rows(), states=3, rounds=1).collect())
    assert [r[:5] for r in found] == [w[:5] for w in wanted]
    assert np.allclose([r[5] for r in found], [w[5] for w in wanted]) and all(r[6] < 0 for r in found)
    assert hmm.scored(nothing, hmm.held_out_rows()).count() == 0


def test_forward_sums_all_paths():
    rng = np.random.default_rng(3)
    first, move, emit = rng.dirichlet([1] * 2), rng.dirichlet([1] * 2, 2), rng.dirichlet([1] * 4, 2).T
    lengths = np.array([5, 1, 3])
    symbols = rng.integers(0, 4, lengths.sum())
    begun, moves, counts = hmm.expected(symbols, lengths, first, move, emit)
    scores, at = hmm.likelihoods(symbols, lengths, first, move, emit), 0
    for n, score in zip(lengths, scores):
        s, p = symbols[at:at + n], 0.0
        for path in np.ndindex(*[2] * n):
            q = first[path[0]] * emit[s[0], path[0]]
            for a, b, x in zip(path, path[1:], s[1:]):
                q *= move[a, b] * emit[x, b]
            p += q
        assert abs(score - math.log10(p)) < 1e-9
        at += n
    assert np.isclose(begun.sum(), 3) and np.isclose(moves.sum(), lengths.sum() - 3) and np.isclose(counts.sum(), lengths.sum())
    better = hmm.likelihoods(symbols, lengths, begun / begun.sum(), moves / moves.sum(1, keepdims=True), counts / counts.sum(0))
    assert better.sum() >= scores.sum()


def test_sentencepiece_against_dynamic_program(llm_spark, corpus, nothing):
    rows, docs = corpus
    model = sentencepiece.model(PIECES)
    longest = max(map(len, model.pieces))

    def brute(t):
        if not t:
            return []
        s, own = "▁" + t.replace(" ", "▁"), [False] + [c == "▁" for c in t]
        best, back = [0.0] + [-math.inf] * len(s), [None] * (len(s) + 1)
        for e in range(1, len(s) + 1):
            for b in range(max(0, e - longest), e):
                piece = model.pieces.get(s[b:e])
                if piece and not any(own[b:e]) and best[b] + piece[0] > best[e]:
                    best[e], back[e] = best[b] + piece[0], (b, [piece[1]])
            if (own[e - 1] or s[e - 1] not in model.pieces) and best[e - 1] + model.unknown > best[e]:
                best[e], back[e] = best[e - 1] + model.unknown, (e - 1, [model.bytes_id[b] for b in s[e - 1].encode()])
        out, at = [], len(s)
        while at:
            at, ids = back[at]
            out = ids + out
        return out

    found = sentencepiece.decoded(sentencepiece.encoded(docs, PIECES), PIECES).collect()
    same_rows([(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in found], [(i, brute(t), t or "") for i, t in rows])
    assert sentencepiece.encoded(nothing, PIECES).count() == 0


def test_a_bpe_model_merges_as_its_library_does(llm_spark, corpus):
    import sentencepiece as library

    rows, docs = corpus
    rows = rows + [(9000, "Elle va à l'école ; les enfants jouent   dehors.\n\tDas Mädchen reads naïve 日本語 books")]
    docs = llm_spark.createDataFrame([r for r in rows if "▁" not in (r[1] or "")], "doc_id long, text string")
    theirs = library.SentencePieceProcessor(model_file=PIECES)
    wanted = [(i, theirs.encode(t or ""), t or "") for i, t in rows if "▁" not in (t or "")]
    found = sentencepiece.decoded(sentencepiece.encoded(docs, PIECES, own_rule=True), PIECES).collect()
    same_rows([(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["text"]) for r in found], wanted)


def test_long_pairs_are_tried_again(llm_spark):
    pairs = llm_spark.range(3).select(F.col("id").alias("pair"), F.transform(F.sequence(F.lit(1), F.col("id") * 700 + 1), lambda x: fingerprint._digest(x)).alias("left"),
                                      F.array(fingerprint._digest(F.lit(1).cast("long"))).alias("right"))
    assert {r["pair"]: r["n_different"] for r in fingerprint.differences(pairs).collect()} == {1: 700, 2: 1400}


def test_sentencepiece_admissible_pieces_against_the_library():
    """The automaton's path under merge order, on every distinct word of a table, broken words and unknown characters."""
    import pyarrow.parquet as pq
    import sentencepiece as library

    ours, theirs = sentencepiece.model(PIECES, own_rule=True), library.SentencePieceProcessor(model_file=PIECES)
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t]
    words = {w for t in texts for w in t.split()} | {"a" * 50, "aaab" * 40, "eleelle" * 9, "\U0001f600x\U0001f600\U0001f600", "x\U0001f600", "zzzzzzzzz", "1234567890" * 5}
    words |= {w[::-1] for w in sorted(words)[::7]}
    words = sorted(w for w in words if sentencepiece.SPACE not in w)
    assert len(words) > 5000
    for w in words:
        text = sentencepiece.SPACE + w
        ids = ours.viterbi(text)
        assert ids == theirs.encode(w), w
        known = [i for i in ids if not theirs.is_byte(i)]
        if len(known) == len(ids):
            assert [len(ours.names[i]) for i in ids] == ours.merge(text)
    ours.pairs.clear()
    before = sentencepiece.PAIRS
    try:
        sentencepiece.PAIRS = 3  # verdicts forgotten all the time
        assert all(ours.viterbi(sentencepiece.SPACE + w) == theirs.encode(w) for w in words[:300])
    finally:
        sentencepiece.PAIRS = before
