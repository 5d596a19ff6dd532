"""Language-model scores of whole texts by a hidden Markov model over words.

Counts of all words of all training documents come first. The LISTED most frequent words (seen LEAST times or
more, of 64 bytes at most, so the list is bounded) are symbols of their own; every other word is the symbol RARE times its share among
rare words, (c + 1) / (rare tokens + rare words + 1), which no state changes. So the model covers an open
vocabulary and its likelihood is exact: the scaled forward recursion gives the symbols' part, an equi-join of
rare words with their counts the rest. A text ends with the symbol END.

Training is Baum-Welch. States are first told apart on a bounded sample (SAMPLE documents of at most LONGEST
tokens, on the driver); then each of ROUNDS rounds sums expected counts over every training document across
partitions: a task adds up its own, and the sums meet by chunks of symbols.

Defined results: a null text is empty (END alone); a null doc_id counts as the empty text for the split;
equal doc_ids stay rows of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyhive.llm.common import flushes, prepare, spans, stored, table, words_of

LISTED, LEAST, LONGEST_WORD = 1 << 17, 10, 64
STATES, ROUNDS = 8, 2
SAMPLE, LONGEST, SAMPLE_ROUNDS = 600, 2_000, 25
FLUSH, CHUNK = 16 << 20, 1024
PRIOR = 3.0  # pseudo-counts that draw a word's share of states towards all words' share


def _words(rows: pa.RecordBatch):
    return words_of(pc.ascii_lower(rows.column("text")))


def _count(batches):
    for rows in flushes(batches, FLUSH):
        _, words = _words(rows)
        met = pc.value_counts(words)
        yield pa.RecordBatch.from_arrays([met.field("values").cast(pa.string()), met.field("counts")], names=["word", "n"])


class Layout:
    """Sequences of symbols laid out step by step: at each step those not yet ended, longest first."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.order = np.argsort(-lengths, kind="stable")
        sizes = lengths[self.order]
        steps = int(sizes[0]) if len(sizes) else 0
        self.active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), side="right")
        self.start = np.cumsum(self.active) - self.active
        rank = np.empty(len(lengths), np.int64)
        rank[self.order] = np.arange(len(lengths))
        step = spans(np.zeros(len(lengths), np.int64), lengths)
        self.symbol = np.empty(len(symbols), np.int64)
        self.symbol[self.start[step] + np.repeat(rank, lengths)] = symbols


def forward(at: Layout, first: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward variables and scales by step, and the emissions used. emit: symbol x state."""
    e = emit[at.symbol]
    alpha, scale, a = np.empty_like(e), np.empty(len(e)), None
    for s, n in zip(at.start.tolist(), at.active.tolist()):
        a = (first if a is None else a[:n] @ move) * e[s:s + n]
        c = a.sum(1)
        a /= c[:, None]
        alpha[s:s + n], scale[s:s + n] = a, c
    return alpha, scale, e


def likelihoods(symbols: np.ndarray, lengths: np.ndarray, first, move, emit) -> np.ndarray:
    """log10 probability of each sequence."""
    at = Layout(symbols, lengths)
    _, scale, _ = forward(at, first, move, emit)
    logs, out, total = np.log10(scale), np.zeros(len(lengths)), np.zeros(len(lengths))
    for s, n in zip(at.start.tolist(), at.active.tolist()):
        total[:n] += logs[s:s + n]
    out[at.order] = total
    return out


def expected(symbols: np.ndarray, lengths: np.ndarray, first, move, emit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts: of first states, of moves, of symbols by state."""
    at = Layout(symbols, lengths)
    alpha, scale, e = forward(at, first, move, emit)
    back, sent = np.ones_like(alpha), e / scale[:, None]
    b, back_move = None, np.ascontiguousarray(move.T)
    for t in range(len(at.start) - 1, -1, -1):
        s, n = int(at.start[t]), int(at.active[t])
        if b is not None:
            back[s:s + len(b)] = b @ back_move
        sent[s:s + n] *= back[s:s + n]
        b = sent[s:s + n]
    later = np.arange(int(at.active[0]) if len(at.active) else 0, len(alpha))
    step = np.repeat(np.arange(len(at.start)), at.active)[later]
    earlier = at.start[step - 1] + later - at.start[step]
    moves = (alpha[earlier].T @ sent[later]) * move
    alpha *= back
    counts = np.stack([np.bincount(at.symbol, weights=alpha[:, k], minlength=len(emit)) for k in range(len(first))], axis=1)
    begun = alpha[:int(at.active[0])].sum(0) if len(at.active) else np.zeros(len(first))
    return begun, moves, counts


def estimated(begun: np.ndarray, moves: np.ndarray, counts: np.ndarray, common: np.ndarray):
    """Parameters from counts; a symbol's states are drawn towards those of all symbols, its total stays."""
    first, moves = begun + 0.1, moves + 0.1
    total, share = counts.sum(1, keepdims=True), (counts.sum(0) + 1) / (counts.sum() + counts.shape[1])
    emit = total * (counts + PRIOR * share) / (total + PRIOR) + common[:, None] * share
    return first / first.sum(), moves / moves.sum(1, keepdims=True), emit / emit.sum(0)


def separated(symbols: np.ndarray, lengths: np.ndarray, common: np.ndarray, states: int, rounds: int):
    """Start: states that stay, told apart on a sample. Documents are dealt to states by a few rounds of a
    mixture of word distributions, then Baum-Welch refines them."""
    rng = np.random.default_rng(7)
    n, owner = len(lengths), np.repeat(np.arange(len(lengths)), lengths)
    share = rng.dirichlet(np.full(states, 0.3), size=max(n, 1))[:n]
    for _ in range(rounds if n else 0):
        counts = np.stack([np.bincount(symbols, weights=share[owner, k], minlength=len(common)) for k in range(states)], axis=1)
        _, _, emit = estimated(np.ones(states), np.ones((states, states)), counts, common)
        logs = np.stack([np.bincount(owner, weights=np.log(emit[symbols, k]), minlength=n) for k in range(states)], axis=1)
        logs = (logs + np.log(share.mean(0) + 1e-3)) / np.maximum(1, lengths[:, None] / 50)  # soft, or documents never change sides
        share = np.exp(logs - logs.max(1, keepdims=True))
        share /= share.sum(1, keepdims=True)
    if not n:
        emit = np.repeat(common[:, None], states, axis=1)
    emit = emit * rng.uniform(0.9, 1.1, emit.shape)
    model = np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1)), emit / emit.sum(0)
    model = (model[0], model[1] / model[1].sum(1, keepdims=True), model[2])
    for _ in range(rounds // 3 if n else 0):
        model = estimated(*expected(symbols, lengths, *model), common)
    return model


def _coded(listed: list[str], logs: np.ndarray):
    """Texts to symbols. listed: the frequent words in order; logs: log10(c + 1) of each symbol, RARE's unused."""
    rare, end = len(listed), len(listed) + 1
    names = ["row", "doc_id", "held_out", "n_tokens", "n_listed", "listed_log", "symbols", "rare"]

    def run(batches):
        known, part, seq = pa.array(listed, pa.large_string()), TaskContext.get().partitionId(), 0
        for rows in flushes(batches, FLUSH):
            bounds, words = _words(rows)
            met = words.cast(pa.large_string()).dictionary_encode()
            which = met.indices.to_numpy()
            symbol = (pc.index_in(met.dictionary, value_set=known).fill_null(rare).to_numpy().astype(np.int32) if len(met.dictionary) else np.zeros(0, np.int32))[which]
            n, count = len(bounds) - 1, np.diff(bounds)
            owner = np.repeat(np.arange(n), count)
            out = np.full(len(symbol) + n, end, np.int32)
            out[spans(bounds[:-1] + np.arange(n), count)] = symbol
            edges = bounds + np.arange(n + 1)
            is_rare = symbol == rare
            rare_before = np.concatenate([[0], np.cumsum(is_rare)])[bounds]
            log_sum = np.bincount(owner, weights=np.where(is_rare, 0, logs[symbol]), minlength=n) + logs[end]
            cells = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(edges * 4), pa.py_buffer(out.tobytes())]).cast(pa.binary())
            strings = met.dictionary.take(pa.array(which[is_rare])).cast(pa.string())
            yield pa.RecordBatch.from_arrays([
                pa.array((part << 33) + seq + np.arange(n)), rows.column("doc_id"), rows.column("held_out"), pa.array(count + 1),
                pa.array(count - np.diff(rare_before)), pa.array(log_sum), cells, pa.ListArray.from_arrays(pa.array(rare_before, pa.int32()), strings)], names=names)
            seq += n

    return run


def _sequences(batches, limit: int = 400_000):
    """Whole documents of about `limit` symbols at a time: rows, symbols, lengths."""
    held, size = [], 0
    for batch in batches:
        for i, cell in enumerate(batch.column("symbols")):
            held.append((batch.column(0)[i].as_py(), cell.as_buffer()))
            size += held[-1][1].size // 4
            if size >= limit:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    data = [np.frombuffer(b, np.int32) for _, b in held]
    return [r for r, _ in held], np.concatenate(data), np.array([len(d) for d in data], np.int64)


def _summed(model):
    states = len(model[0])

    def run(batches):
        begun, moves, counts = np.zeros(states), np.zeros((states, states)), np.zeros(model[2].shape)
        for _, symbols, lengths in _sequences(batches):
            for total, part in zip((begun, moves, counts), expected(symbols, lengths, *model)):
                total += part
        rows = [(-1, np.concatenate([begun, moves.reshape(-1)]).tobytes())] + [(i, counts[i:i + CHUNK].tobytes()) for i in range(0, len(counts), CHUNK)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["chunk", "sums"])

    return run


def _added(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, sums in zip(batch.column("chunk").to_pylist(), batch.column("sums").to_pylist()):
            part = np.frombuffer(sums)
            total[chunk] = total[chunk] + part if chunk in total else part
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "sums"])


def baum_welch(coded: DataFrame, model, common: np.ndarray):
    """One round over all training documents."""
    states = len(model[0])
    parts = coded.where("not held_out").select("row", "symbols").mapInArrow(_summed(model), "chunk int, sums binary")
    sums = parts.repartition("chunk").mapInArrow(_added, "chunk int, sums binary").collect()  # as many values as the model has
    begun, moves, counts = np.zeros(states), np.zeros((states, states)), np.zeros(model[2].shape)
    for row in sums:
        values = np.frombuffer(row["sums"])
        if row["chunk"] < 0:
            begun += values[:states]
            moves += values[states:].reshape(states, states)
        else:
            part = values.reshape(-1, states)
            counts[row["chunk"]:row["chunk"] + len(part)] += part
    return estimated(begun, moves, counts, common)


def scored(docs: DataFrame, held_out, listed: int = LISTED, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """Learn from the rows where the column `held_out` is false and score all rows.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram), score (the model's).
    """
    spark = prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), held_out.alias("held_out"))
    counts = stored(texts.where("not held_out").select("text").mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("tokens"), F.count("*").alias("words")).first()
    ends = texts.where("not held_out").count()
    frequent = counts.where((F.octet_length("word") <= LONGEST_WORD) & (F.col("c") >= LEAST))
    frequent = frequent.repartition(8).orderBy(F.desc("c"), "word").limit(listed).collect()  # each of 8 tasks sends `listed` rows at most
    words, c = [r["word"] for r in frequent], np.array([r["c"] for r in frequent], np.int64)
    tokens, distinct = int(whole["tokens"]) + ends, int(whole["words"]) + (ends > 0)
    rare_tokens, rare_words = int(whole["tokens"]) - int(c.sum()), int(whole["words"]) - len(words)
    common = np.concatenate([c, [rare_tokens, ends]]) + 0.5
    common = common / common.sum()
    logs = np.log10(np.concatenate([c, [0, ends]]) + 1.0)
    coded = stored(texts.mapInArrow(_coded(words, logs), "row long, doc_id long, held_out boolean, n_tokens long, n_listed long, listed_log double, symbols binary, rare array<string>"), "symbols")

    sample = (coded.where(F.expr("not held_out") & (F.col("n_tokens") <= LONGEST)).orderBy(F.xxhash64("row")).limit(SAMPLE).select("row", "symbols").collect())
    start = _joined([(r["row"], bytes(r["symbols"])) for r in sample]) if sample else ([], np.zeros(0, np.int64), np.zeros(0, np.int64))
    model = separated(start[1].astype(np.int64), start[2], common, states, SAMPLE_ROUNDS)
    for _ in range(rounds):
        model = baum_welch(coded, model, common)

    def score(batches):
        for rows, symbols, lengths in _sequences(batches):
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(likelihoods(symbols, lengths, *model))], names=["row", "symbol_score"])

    scores = coded.select("row", "symbols").mapInArrow(score, "row long, symbol_score double")
    by_word = coded.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = by_word.groupBy("row").agg(F.count("*").alias("n_rare"), F.count("c").alias("n_rare_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("rare_log"))
    zero = F.lit(0)
    n_rare, rare_log = F.coalesce("n_rare", zero), F.coalesce("rare_log", F.lit(0.0))
    joined = coded.select("row", "doc_id", "held_out", "n_tokens", "n_listed", "listed_log").join(scores, "row").join(rare, "row", "left")
    per_token, per_rare = float(np.log10(tokens + distinct + 1)), float(np.log10(rare_tokens + rare_words + 1))
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("n_listed") + F.coalesce("n_rare_known", zero) + F.lit(int(ends > 0))).alias("n_known"),
                         F.lit(tokens).cast("long").alias("train_tokens"), (F.col("listed_log") + rare_log - F.col("n_tokens") * per_token).alias("base_score"),
                         (F.col("symbol_score") + rare_log - n_rare * per_rare).alias("score"))


def held_out_rows():
    """crc32 of the doc_id as text, modulo 7, is 2."""
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 7 == 2


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return scored(table(spark, sf_dir, "documents"), held_out_rows())
