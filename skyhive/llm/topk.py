"""Exact top-k by inner product with MaxScore.

A vector is read as a document with one term per component and sign; the term's weight is the component's
size. For a query, each term of matching sign has a bound: the query's weight times the shard's largest
weight in that posting (other signs only lower a score). Terms are sorted by bound. Those whose bounds
together stay below the k-th best score so far are non-essential: no vector can enter through them alone.
The postings of essential terms are traversed; what remains is probed, a few terms at a time, only for
vectors whose score so far plus the bounds to come can still compete.

Vectors are packed into shards. Blocks of queries meet groups of shards, each pair in one task that carries
its k-th best scores from shard to shard; the shards' answers are merged by a rank with a map-side limit.

Defined results: a row takes part if its id and its vector are not null and all components are finite; a
shorter vector counts as filled with zeros; repeated ids are rows of their own, and only the query's own row
is left out; ties go to the smaller id; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyhive.llm.common import prepare, stored, table

SHARD, SHARDS, QUERIES, PROBE = 4096, 4, 256, 8


def _pack(scale: int, every: int, shard: int):
    names = ["shard", "n", "width", "ids", "vectors", "n_queries", "rows"]

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        ids, lengths, values = [], [], []

        def close():
            nonlocal seq, ids, lengths, values
            size, flat, key = np.concatenate(lengths), np.concatenate(values), np.concatenate(ids)
            ids, lengths, values = [], [], []
            start = np.cumsum(size) - size
            for s in range(0, len(key), shard):
                n = size[s:s + shard]
                matrix = np.zeros((len(n), int(n.max(initial=0))), np.int64)
                matrix[np.arange(matrix.shape[1])[None, :] < n[:, None]] = np.floor(scale * flat[start[s]:start[s] + n.sum()])
                k = key[s:s + shard]
                rows = np.flatnonzero(k % every == 0)
                seq += 1
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), pa.array([len(k)], pa.int32()), pa.array([matrix.shape[1]], pa.int32()),
                                                  pa.array([k.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary()),
                                                  pa.array([len(rows)], pa.int32()), pa.array([rows.astype(np.int64).tobytes()], pa.binary())], names=names)

        for batch in batches:
            vectors = batch.column("vector")
            ids.append(batch.column("id").to_numpy())
            lengths.append(np.diff(vectors.offsets.to_numpy()).astype(np.int64))
            values.append(vectors.flatten().to_numpy().astype(np.float64))
            if sum(map(len, ids)) >= shard:
                yield from close()
        if ids:
            yield from close()

    return run


class Best:
    """The k best of one query so far, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        return self.score[-1] if len(self.score) == self.k else -np.inf

    def add(self, score: np.ndarray, key: np.ndarray) -> None:
        score, key = np.concatenate([self.score, score]), np.concatenate([self.id, key])
        order = np.lexsort((key, -score))[:self.k]
        self.score, self.id = score[order], key[order]


def max_score(terms: np.ndarray, key: np.ndarray, query: np.ndarray, own: int, best: Best, largest: np.ndarray, smallest: np.ndarray) -> None:
    """Enter one shard into `best`. terms: component x vector; own: the query's row in this shard or -1."""
    bound = np.where(query > 0, query * largest, query * smallest)
    order = np.argsort(-bound, kind="stable")
    after = np.append(np.cumsum(bound[order][::-1])[::-1], 0)  # bounds of the terms from a place on
    essential = int(np.argmax(after < best.least)) if after[-1] < best.least else len(order)
    score = query[order[:essential]] @ terms[order[:essential]]
    alive = np.flatnonzero(score + after[essential] >= best.least)
    alive, score = alive[alive != own], score[alive[alive != own]]
    for at in range(essential, len(order), PROBE):
        if not len(alive):
            return
        some = order[at:at + PROBE]
        score = score + query[some] @ terms[np.ix_(some, alive)]
        on = score + after[min(at + PROBE, len(order))] >= best.least
        alive, score = alive[on], score[on]
    if len(alive) > best.k:
        floor = np.partition(score, -best.k)[-best.k]
        alive, score = alive[score >= floor], score[score >= floor]
    best.add(score.astype(np.int64), key[alive])


def _search(k: int):
    schema = pa.schema([("shard", pa.int64()), ("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(shards: pa.Table, queries: pa.Table) -> pa.Table:
        asked = []
        for q in queries.to_pylist():
            matrix = np.frombuffer(q["vectors"], np.int64).reshape(-1, q["width"])
            asked += [(q["shard"], int(r), i, v, Best(k)) for r, i, v in zip(np.frombuffer(q["rows"], np.int64), np.frombuffer(q["ids"], np.int64), matrix)]
        for s in range(shards.num_rows):
            row = shards.slice(s, 1).to_pylist()[0]
            matrix, key = np.frombuffer(row["vectors"], np.int64).reshape(row["n"], row["width"]), np.frombuffer(row["ids"], np.int64)
            reach, views = int(np.abs(matrix).max(initial=0)), {}
            largest, smallest = matrix.max(0, initial=0), matrix.min(0, initial=0)
            for shard, place, _, vector, best in asked:
                width = min(len(vector), row["width"])
                query = vector[:width]
                exact = reach * int(np.abs(query).max(initial=0)) * max(1, width) < 1 << 52  # then doubles hold every sum
                kind = np.float64 if exact else np.int64
                if kind not in views:
                    views[kind] = (np.ascontiguousarray(matrix.T.astype(kind)), largest.astype(kind), smallest.astype(kind))
                terms, high, low = views[kind]
                max_score(terms[:width], key, query.astype(kind), place if shard == row["shard"] else -1, best, high[:width], low[:width])
        found = [(shard, place, i, int(v), int(c)) for shard, place, i, _, best in asked for v, c in zip(best.id, best.score)]
        columns = list(zip(*found)) if found else [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], schema=schema)

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, shard: int = SHARD) -> DataFrame:
    """Queries are the rows whose id is divisible by `every`; per query its k best other rows.

    vectors: id long, vector array. Components count as floor(scale * x). Returns query_id, rank, vec_id, score.
    """
    prepare(vectors.sparkSession)
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("id is not null and vector is not null").where(sound)
    packed = stored(clean.mapInArrow(_pack(scale, every, shard), "shard long, n int, width int, ids binary, vectors binary, n_queries int, rows binary"), "shards")
    size = packed.agg(F.count("*").alias("shards"), F.sum("n_queries").alias("queries")).first()
    groups, blocks = max(1, -(-size["shards"] // SHARDS)), max(1, -(-(size["queries"] or 0) // QUERIES))
    mine = lambda n: F.pmod(F.xxhash64("shard"), F.lit(n)).cast("int")
    sent = packed.select("shard", "n", "width", "ids", "vectors", mine(groups).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = packed.where("n_queries > 0").mapInArrow(_queries, "shard long, width int, ids binary, vectors binary, rows binary")
    asked = asked.select("*", mine(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    found = sent.groupBy("block", "group").cogroup(asked.groupBy("block", "group")).applyInArrow(
        _search(k), "shard long, row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("shard", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _queries(batches):
    """The query rows of each shard, packed by themselves."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            rows = np.frombuffer(r["rows"], np.int64)
            ids, vectors = np.frombuffer(r["ids"], np.int64)[rows], np.frombuffer(r["vectors"], np.int64).reshape(r["n"], r["width"])[rows]
            out.append((r["shard"], r["width"], ids.tobytes(), vectors.tobytes(), r["rows"]))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["shard", "width", "ids", "vectors", "rows"])


def op10_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    return top_k(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))


OP10_SQL = """
with v as (select vec_id, [floor(256 * x::double)::bigint for x in embedding] e from embeddings
           where vec_id is not null and embedding is not null
             and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
q as (select vec_id query_id, e from v where vec_id % 50 = 0),
s as (select query_id, v.vec_id, list_inner_product(q.e::double[], v.e::double[])::bigint score from q join v on q.query_id <> v.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
