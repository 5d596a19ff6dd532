"""Whitening by principal components, found with Chebyshev-filtered subspace iteration.

Components become whole numbers x = floor(scale * c) + offset. The fit list is each distinct x vector once, kept as
packed blocks. Nothing but passes over those blocks touches the data, and each pass multiplies: Y = XᵀXQ / n with X the
centred fit list and Q a block of m columns. Tasks send one dimensions-by-m sum each, added up in groups.

One round: Rayleigh-Ritz on the block (Q from a QR decomposition, a pass for VQ, eigenvectors of QᵀVQ); then, unless
the wanted components are certified, `degree` more passes run the three-term recurrence of the Chebyshev polynomial
on [0, b], b the smallest Ritz value of the block: it stays within 1 there and grows beyond. Certified means that the
residual |Vu - eu| of each wanted component is below `tolerance` times the largest eigenvalue. Where a block as wide as
the space is possible, the first round is exact. Uncertified after `rounds` raises an error.

Defined results: rows whose vector is null or holds null or non-finite entries take no part, and neither do vectors
that differ in length from the most common one (ties: the longer), since they have no place in the space; vec_id may be null or
repeated; components with an eigenvalue of zero to rounding (fewer distinct vectors than dimensions) cannot be whitened and are left
out; a table without a sound vector gives no rows; other columns are not read. A deviation beyond 64 bits raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyhive.llm.common import prepare, stored, table

#: Vectors in a block, blocks' bytes for each task of a pass, columns beyond the wanted ones.
BLOCK, TASK_BYTES, SPARE = 2048, 64 << 20, 16
DEGREE, ROUNDS, TOLERANCE = 12, 60, 1e-13


def _sound(vectors: DataFrame) -> DataFrame:
    good = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null").where(good)


def _packed(batches):
    """Rows of whole numbers as blocks of bytes."""
    held, count = [], 0
    for batch in batches:
        lists = batch.column("x")
        held.append(lists.flatten().to_numpy())
        count += batch.num_rows
        if count >= BLOCK:
            yield _block(held, count)
            held, count = [], 0
    if count:
        yield _block(held, count)


def _block(held, count):
    return pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([np.concatenate(held).astype(np.int64).tobytes()], pa.binary())], names=["rows", "data"])


def centred(x: np.ndarray, sums: np.ndarray, n: int) -> np.ndarray:
    """x - S / n, its numerator exact where it fits 64 bits: whole and fractional parts of S / n apart."""
    whole, rest = sums // n, sums % n
    return (x - whole) - rest / n


class Fit:
    """The fit list as blocks in a table, and passes over it."""

    def __init__(self, blocks: DataFrame, width: int, n: int, sums: np.ndarray):
        self.width, self.n, self.sums = width, n, sums
        tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-n * width * 8 // TASK_BYTES))
        self.blocks = blocks.coalesce(tasks)

    def summed(self, of, size: int) -> np.ndarray:
        """Sum over all blocks of an array of doubles made of each block's centred rows."""
        width, n, sums = self.width, self.n, self.sums

        def task(batches):
            total = np.zeros(size)
            for batch in batches:
                for data in batch.column("data"):
                    total += of(centred(np.frombuffer(data.as_buffer(), np.int64).reshape(-1, width), sums, n)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

        rows = self.blocks.mapInArrow(task, "part binary")
        if self.blocks.rdd.getNumPartitions() > 256:  # sums of sums, so that the driver gets 64 arrays at most
            rows = rows.coalesce(64).mapInArrow(_added, "part binary")
        return sum((np.frombuffer(bytes(r["part"])) for r in rows.collect()), np.zeros(size))  # 256 arrays at most

    def times(self, q: np.ndarray) -> np.ndarray:
        """VQ."""
        return self.summed(lambda c: c.T @ (c @ q), q.size).reshape(q.shape) / self.n


def _added(batches):
    total = 0
    for batch in batches:
        for part in batch.column("part"):
            total = total + np.frombuffer(part.as_buffer())
    if not np.isscalar(total):
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])


def principal(fit, wanted: int, degree: int = DEGREE, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues, unit eigenvectors as columns, passes) of the `wanted` largest, certified. fit: width, times(q)."""
    width = min(fit.width, wanted + SPARE)
    wanted = min(wanted, fit.width)
    q, passes, last = np.linalg.qr(np.random.default_rng(7).standard_normal((fit.width, width)))[0], 0, np.inf
    for _ in range(rounds):
        vq = fit.times(q)
        small = q.T @ vq
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        u, vu = q @ turn, vq @ turn
        passes += 1
        left = np.linalg.norm(vu - u * value, axis=0)[:wanted].max(initial=0)
        scale = max(value[0], 0.0)
        if width == fit.width or left <= tolerance * scale or (left >= last / 2 and left <= 100 * tolerance * scale):  # no better to rounding
            return value[:wanted], u[:, :wanted], passes
        last = left
        half = max(value[-1], 1e-300) / 2  # centre and half width of the unwanted interval [0, 2 half]
        before, now = u, vu / half - u
        for _ in range(degree - 1):
            before, now = now, 2 * (fit.times(now) / half - now) - before
            passes += 1
            size = np.linalg.norm(now, axis=0)  # columns may be scaled alike in both terms
            before, now = before / size, now / size
        q = np.linalg.qr(now)[0]
    raise RuntimeError(f"components not certified: residual {left:.3g} of {scale:.3g} after {passes} passes")


def whiten(vectors: DataFrame, wanted: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each sound row and component.

    vectors: id long, vector array.
    """
    spark = prepare(vectors.sparkSession)
    x = F.transform("vector", lambda c: F.floor(scale * c).cast("long") + offset)
    rows = _sound(vectors).select("id", x.alias("x"))
    sizes = rows.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    empty = spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    if sizes is None or sizes["width"] == 0:
        return empty
    width = sizes["width"]
    rows = rows.where(F.size("x") == width)
    distinct = rows.select("x").distinct()
    blocks = stored(distinct.mapInArrow(_packed, "rows long, data binary"), "fit", "none")
    n, sums = 0, np.zeros(width, object)
    for r in blocks.mapInArrow(_sums(width), "rows long, sums array<long>").toLocalIterator():  # a row of `width` numbers a task
        n, sums = n + r["rows"], sums + np.array(r["sums"], object)
    fit = Fit(blocks, width, n, sums.astype(np.int64))
    trace = float(fit.summed(lambda c: np.einsum("ij,ij->j", c, c), width).sum()) / n
    value, vector, _ = principal(fit, wanted)
    kept = value > 1e-12 * max(value[0], 0.0) if trace > 0 else np.zeros(len(value), bool)
    value, vector = value[kept], vector[:, kept]
    if not len(value):
        return empty
    base = vector / np.sqrt(value)
    grams = fit.summed(lambda c: (c @ base).T @ (c @ base), len(value) ** 2).reshape(len(value), -1) / n
    means = fit.summed(lambda c: (c @ base).sum(0), len(value)) / n
    error = float(np.abs(grams - np.outer(means, means) - np.eye(len(value))).max())
    whole = rows.mapInArrow(_whitened(base, fit.sums, n, width), "vec_id long, deviation long, component int, whitened double")
    shares = F.get(F.array(*[F.lit(float(v / trace)) for v in value]), F.col("component") - 1)
    return whole.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"), F.lit(error).alias("identity_error"))


def _sums(width: int):
    def run(batches):
        rows, sums = 0, np.zeros(width, np.int64)
        for batch in batches:
            for data in batch.column("data"):
                block = np.frombuffer(data.as_buffer(), np.int64).reshape(-1, width)
                rows, sums = rows + len(block), sums + block.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["rows", "sums"])

    return run


def _whitened(base: np.ndarray, sums: np.ndarray, n: int, width: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy().reshape(-1, width)
            off = np.abs(x - sums // n).max() + 1
            if off * n < 1 << 62 and float(off * n) ** 2 * width < 2.0 ** 62:
                numerator = n * (x - sums // n) - sums % n
                deviation = (numerator * numerator).sum(1)
            else:
                numerator = x.astype(object) * n - sums.astype(object)
                deviation = (numerator * numerator).sum(1).tolist()  # beyond 64 bits: pyarrow raises an error
            out, m = centred(x, sums, n) @ base, base.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(np.repeat(np.arange(len(x)), m))), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), m))),
                                              pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(out.ravel())], names=["vec_id", "deviation", "component", "whitened"])

    return run


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whiten(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
