"""Byte-level BPE encoding and decoding by ranked merges over distinct words.

A text falls into matches of the vocabulary's pattern. Each distinct word starts as one id per byte and is folded:
every step merges the leftmost of the adjacent pairs with the lowest rank and looks up the two pairs that are new,
until no pair has a rank. Decoding concatenates the byte strings of the ids.

The fold stands here twice, with equal results. `merger` is a Spark expression of higher-order functions with the
rank map as a literal of the plan (`encode_words`); Spark interprets such functions at some 150 microseconds a word,
more than the limits allow for the distinct words of a corpus, so texts (`encode`) are folded in the tasks' Python,
some 10 microseconds a word, each distinct word once per cache. `encode` needs no shuffle. Words of more than LONG
bytes take their merges from a heap, in the same order, since the fold's cost is the square of a word's length.

Defined results: null text counts as empty (no ids); strings of special tokens are ordinary text; rows with
repeated or null doc_id are rows of their own; an empty table gives no rows; other columns are not read. A word
that is an entry of the vocabulary is its id, as in tiktoken.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyhive.llm.bpe import PieceEncoder, cuts
from skyhive.llm.common import id_and_text, prepare, spans, table

#: Longest word in bytes that is folded, not merged by a heap.
LONG = 64
#: Rank of a pair that does not merge; a factor that spreads pairs over buckets.
NONE, STRIDE = 1 << 30, 7919


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 byte string and its rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """left << 32 | right -> rank of the two joined, for all pairs of ids whose joined bytes are an entry."""
    found = {}
    for word, rank in ranks.items():
        for i in range(1, len(word)):
            left, right = ranks.get(word[:i]), ranks.get(word[i:])
            if left is not None and right is not None:
                found[left << 32 | right] = rank
    return found


class Vocabulary:
    """A rank file as a worker uses it."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        self.pairs = pair_ranks(self.ranks)
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        by_id = sorted(self.ranks.items(), key=lambda x: x[1])
        self.length = np.zeros(by_id[-1][1] + 1, np.int64)
        self.length[[i for _, i in by_id]] = [len(w) for w, _ in by_id]
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(w for w, _ in by_id), np.uint8)

    def encode(self, word: bytes) -> list[int]:
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        ids = [self.single[b] for b in word]
        return self.folded(ids) if len(ids) <= LONG else self.by_heap(ids)

    def folded(self, ids: list[int]) -> list[int]:
        rank = self.pairs.get
        ranks = [rank(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks and (low := min(ranks)) < NONE:
            at = ranks.index(low)
            ids[at:at + 2] = [low]
            del ranks[at]
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 32 | low, NONE)
            if at < len(ranks):
                ranks[at] = rank(low << 32 | ids[at + 1], NONE)
        return ids

    def by_heap(self, ids: list[int]) -> list[int]:
        """The same merges for long words: pairs wait in a heap by rank, then place."""
        rank, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            low, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rank(ids[i] << 32 | ids[j]) != low:
                continue  # one of the two has merged since
            ids[i], ids[j], after[i] = low, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := rank(low << 32 | ids[after[j]])) is not None:
                    heapq.heappush(heap, (r, i))
            if before[i] >= 0 and (r := rank(ids[before[i]] << 32 | low)) is not None:
                heapq.heappush(heap, (r, before[i]))
        return [i for i in ids if i >= 0]

    def joined(self, ids: np.ndarray) -> bytes:
        return self.data[spans(self.start[ids], self.length[ids])].tobytes()


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class Encoder(PieceEncoder):
    """Ids of texts; a piece between sure cuts is split by the pattern, each match encoded by itself."""

    def __init__(self, path: str, pattern: str, limit: int = 500_000):
        import regex

        self.words, self.split = vocabulary(path), regex.compile(pattern)
        super().__init__(limit)

    def starts(self, data: np.ndarray) -> np.ndarray:
        return cuts(data)

    def ids_of(self, pieces: list[bytes]) -> list[list[int]]:
        return [[i for word in self.split.findall(piece.decode()) for i in self.words.encode(word.encode())] for piece in pieces]


_encoders: dict[tuple[str, str], Encoder] = {}


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int> of every row. docs: doc_id, text."""
    prepare(docs.sparkSession)

    def run(batches):
        if (path, pattern) not in _encoders:
            _encoders[path, pattern] = Encoder(path, pattern)
        for batch in batches:
            counts, ids = _encoders[path, pattern].encode(batch.column("text"))
            bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded binary. tokens: doc_id, ids array<int> (null: no bytes)."""
    def run(batches):
        for batch in batches:
            texts = [vocabulary(path).joined(x.values.to_numpy()) if x.is_valid else b"" for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], names=["doc_id", "decoded"])

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, decoded binary")


def merger(words: Vocabulary):
    """An expression from a word (binary) to its ids: the fold as higher-order functions over a literal rank map.

    The map is laid out in buckets by a hash of the pair: Spark looks a key of a plain map up from the first entry on.
    """
    n = max(2, (1 << len(words.pairs).bit_length()) // 4)
    keys, ranks = [[] for _ in range(n)], [[] for _ in range(n)]
    for pair, rank in words.pairs.items():
        bucket = ((pair >> 32) * STRIDE + (pair & 0xFFFFFFFF)) % n
        keys[bucket].append(pair)
        ranks[bucket].append(rank)
    keys_of, ranks_of = F.from_json(F.lit(json.dumps(keys)), "array<array<bigint>>"), F.from_json(F.lit(json.dumps(ranks)), "array<array<int>>")
    single = F.from_json(F.lit(json.dumps(words.single)), "array<int>")

    def ranked(a: Column, b: Column) -> Column:
        bucket = (a * STRIDE + b) % n
        at = F.array_position(F.get(keys_of, bucket), F.shiftleft(a.cast("long"), 32) + b)
        return F.coalesce(F.get(F.get(ranks_of, bucket), at.cast("int") - 1), F.lit(NONE))

    def let(value: Column, use) -> Column:
        return F.get(F.transform(F.array(value), use), 0)

    def step(state: Column, _) -> Column:
        parts, ranks, low = state["parts"], state["ranks"], F.array_min(state["ranks"])

        def merged(at: Column) -> Column:
            none = F.slice(ranks, F.lit(1), F.lit(0))
            before = F.when(at > 1, F.array(ranked(F.get(parts, at - 2), low))).otherwise(none)
            after = F.when(at < F.size(ranks), F.array(ranked(low, F.get(parts, at + 1)))).otherwise(none)
            return F.struct(F.concat(F.slice(parts, F.lit(1), at - 1), F.array(low), F.slice(parts, at + 2, F.size(parts))).alias("parts"),
                            F.concat(F.slice(ranks, F.lit(1), F.greatest(at - 2, F.lit(0))), before, after, F.slice(ranks, at + 2, F.size(ranks))).alias("ranks"))

        return F.when(F.coalesce(low, F.lit(NONE)) == NONE, state).otherwise(let(F.array_position(ranks, low).cast("int"), merged))

    def start(parts: Column) -> Column:
        pairs = F.size(parts) - 1
        return F.struct(parts.alias("parts"), F.zip_with(F.slice(parts, F.lit(1), pairs), F.slice(parts, F.lit(2), pairs), ranked).alias("ranks"))

    def folded(word: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(word))
        ids = F.transform(places, lambda i: F.get(single, F.ascii(F.decode(F.substr(word, i, F.lit(1)), "ISO-8859-1"))))
        return F.when(F.length(word) == 0, F.array().cast("array<int>")).otherwise(F.aggregate(places, let(ids, start), step, lambda state: state["parts"]))

    return folded


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """word binary, ids array<int> of each distinct non-null word, by Spark's higher-order functions. words: word binary."""
    return words.where("word is not null").select(F.col("word").cast("binary").alias("word")).distinct().select("word", merger(vocabulary(path))(F.col("word")).alias("ids"))


def digests(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: of the ids and of what they decode to."""
    def run(batches):
        for batch in batches:
            lists = [x.values.to_numpy() for x in batch.column("ids")]
            columns = [batch.column("doc_id"), pa.array(map(len, lists), pa.int64()),
                       pa.array((hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in lists), pa.string()),
                       pa.array((hashlib.sha256(vocabulary(path).joined(x)).hexdigest() for x in lists), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return tokens.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
