"""Token ids in entropy-coded files: static range asymmetric numeral system (rANS).

write_ids counts all ids of the corpus first; the frequency table made from those counts is shared by all
blocks. A block is a run of whole documents of at least BLOCK ids. Its ids are dealt to LANES interleaved
states that share one stream of 32-bit words; every SEGMENT steps the states and the place in the stream
are kept as a checkpoint, so a reader starts at any of them and decodes all segments side by side. Each
block carries the CRC-32 of its ids, and the states must end where the encoder began.

The files: `path/blocks` (Parquet, one row per block, payload not compressed again) and
`path/frequencies` (id, frequency; the sum is a power of two). Ids are in ascending doc_id order.

Defined results: a null text is empty and yields the end id alone; an empty table gives files without
blocks; equal or null doc_ids keep their rows (nulls first, ties by text); extra columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyhive.llm.bpe import encoder
from skyhive.llm.common import discard, flushes, fresh_path, id_and_text, prepare, spans, spread, stored, table

LANES, SEGMENT, BLOCK = 64, 128, 1 << 16
LOW = np.uint64(1 << 31)  # a state stays in [LOW, LOW * 2 ** 32)
WORD = np.uint64(32)

_ID_BLOCKS = "part int, seq int, first long, doc_ids binary, lengths binary, ids binary"
_CODED = ("part int, seq int, first long, n_ids long, doc_ids binary, lengths binary, "
          "payload binary, states binary, offsets binary, crc long")


def normalised(counts: np.ndarray, least_bits: int = 20) -> tuple[np.ndarray, int]:
    """Frequencies of sum 2 ** bits in proportion to the counts, 1 at least where the count is not zero."""
    counts = np.asarray(counts, np.float64)
    used = counts > 0
    bits = max(least_bits, int(used.sum()).bit_length() + 2)
    freq = np.where(used, np.maximum(1, np.floor(counts / max(counts.sum(), 1) * (1 << bits))), 0).astype(np.int64)
    excess = int(freq.sum()) - (1 << bits)
    for i in np.argsort(-freq, kind="stable"):  # the most frequent ids give or take what rounding left
        if not excess or not freq[i]:
            break
        change = min(excess, int(freq[i]) // 2) if excess > 0 else excess
        freq[i] -= change
        excess -= change
    return freq, bits


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.bits = np.uint64(int(freq.sum()).bit_length() - 1)
        self.mask = np.uint64((1 << int(self.bits)) - 1)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - int(self.bits))
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)
        self.filler = int(np.argmax(freq))

    def encode(self, blocks: list[np.ndarray]) -> list[tuple[bytes, bytes, bytes]]:
        """Payload, states and stream offsets of each block; all blocks go through the steps together."""
        steps = np.array([-(-len(b) // LANES) for b in blocks])
        order = np.argsort(-steps, kind="stable")
        most = int(steps.max(initial=0))
        ids = np.full((most, len(blocks), LANES), self.filler, np.int32)
        for row, i in enumerate(order):
            flat = np.full(int(steps[i]) * LANES, self.filler, np.int32)
            flat[:len(blocks[i])] = blocks[i]
            ids[:steps[i], row] = flat.reshape(-1, LANES)
        active = (steps[order][None, :] > np.arange(most)[:, None]).sum(1)
        x = np.full((len(blocks), LANES), LOW, np.uint64)
        words, given = np.zeros(ids.shape, np.uint32), np.zeros(ids.shape, bool)
        kept = np.zeros((-(-most // SEGMENT), len(blocks), LANES), np.uint64)
        for t in range(most - 1, -1, -1):
            n = active[t]
            s, y = ids[t, :n], x[:n]
            f = self.freq[s]
            full = y >= self.limit[s]
            given[t, :n], words[t, :n] = full, y  # the low 32 bits
            y = np.where(full, y >> WORD, y)
            q = y // f
            x[:n] = (q << self.bits) + (y - q * f) + self.cum[s]
            if t % SEGMENT == 0:
                kept[t // SEGMENT] = x
        out: list = [None] * len(blocks)
        for row, i in enumerate(order):
            g = given[:steps[i], row]
            ends = np.concatenate([[0], np.cumsum(g.sum(1))])
            segments = -(-int(steps[i]) // SEGMENT)
            out[i] = (words[:steps[i], row][g].tobytes(), kept[:segments, row].tobytes(),
                      ends[:steps[i]:SEGMENT].astype(np.int64).tobytes())
        return out

    def decode(self, coded: list[tuple[bytes, bytes, bytes, int]]) -> list[np.ndarray]:
        """Ids of blocks given as (payload, states, offsets, number of ids); all segments side by side."""
        if not coded:
            return []
        words = np.concatenate([np.frombuffer(c[0], np.uint32) for c in coded] + [np.zeros(1, np.uint32)]).astype(np.uint64)
        sizes = np.array([len(c[0]) // 4 for c in coded])
        base = np.cumsum(sizes) - sizes
        x = np.concatenate([np.frombuffer(c[1], np.uint64) for c in coded]).reshape(-1, LANES)
        segments = np.array([len(c[2]) // 8 for c in coded])
        pointer = np.concatenate([np.frombuffer(c[2], np.int64) + b for c, b in zip(coded, base)])
        total = np.array([-(-c[3] // LANES) for c in coded])
        steps = np.full(len(x), SEGMENT)
        last = np.cumsum(segments) - 1
        full = segments > 0
        steps[last[full]] = (total - (segments - 1) * SEGMENT)[full]
        order = np.argsort(-steps, kind="stable")
        x, pointer, ordered = x[order].copy(), pointer[order].copy(), steps[order]
        out = np.zeros((SEGMENT, len(x), LANES), np.int32)
        for t in range(int(ordered.max(initial=0))):
            n = int((ordered > t).sum())
            y = x[:n]
            slot = y & self.mask
            s = self.symbol[slot]
            out[t, :n] = s
            y = self.freq[s] * (y >> self.bits) + slot - self.cum[s]
            low = y < LOW
            read = np.cumsum(low, axis=1)
            place = np.where(low, pointer[:n, None] + read - 1, 0)
            x[:n] = np.where(low, (y << WORD) | words[place], y)
            pointer[:n] += read[:, -1]
        ends = np.empty(len(x), np.int64)
        ends[order] = np.arange(len(x))
        result, at = [], 0
        for c, k, b, size in zip(coded, segments, base, sizes):
            rows = ends[at:at + k]
            flat = np.concatenate([out[:steps[at + j], r].reshape(-1) for j, r in enumerate(rows)]) if k else np.zeros(0, np.int32)
            if k and (np.any(x[rows[-1]] != LOW) or pointer[rows[-1]] != b + size):
                raise ValueError("a block does not end in the encoder's first state")
            result.append(flat[:c[3]])
            at += k
        return result


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _gather(vocabulary: str, end_id: int):
    """Whole documents in order to blocks of ids, and the counts of the task's ids in a last row (seq -1)."""
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.binary()),
                        ("lengths", pa.binary()), ("ids", pa.binary())])

    def run(batches):
        part, enc = TaskContext.get().partitionId(), encoder(vocabulary)
        counts = np.zeros(enc.tokenizer.get_vocab_size(), np.int64)
        seq, first = 0, 0
        docs, sizes, chunks, held = [], [], [], 0

        def close():
            nonlocal seq, first, docs, sizes, chunks, held
            row = (part, seq, first, b"".join(docs), b"".join(sizes), b"".join(chunks))
            seq, first, docs, sizes, chunks, held = seq + 1, first + held, [], [], [], 0
            return row

        for batch in flushes(batches, 8 << 20):
            lengths, ids = enc.encode(batch.column("text"))
            lengths = lengths + 1
            out = np.full(int(lengths.sum()), end_id, np.uint32)
            ends = np.cumsum(lengths)
            out[spans(ends - lengths, lengths - 1)] = ids
            counts += np.bincount(out, minlength=len(counts))
            doc_ids = [-1 if d is None else d for d in batch.column("doc_id").to_pylist()]
            has_id = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            rows, at = [], 0
            while at < len(ends):
                before = int(ends[at] - lengths[at])
                stop = min(len(ends), int(np.searchsorted(ends, before + max(1, BLOCK - held))) + 1)
                docs.append(np.array(list(zip(doc_ids[at:stop], has_id[at:stop])), np.int64).tobytes())
                sizes.append(lengths[at:stop].astype(np.int64).tobytes())
                chunks.append(out[before:int(ends[stop - 1])].astype(np.uint16 if len(counts) <= 1 << 16 else np.uint32).tobytes())
                held += int(ends[stop - 1]) - before
                at = stop
                if held >= BLOCK:
                    rows.append(close())
            if rows:
                yield _batch(rows, schema)
        if held:
            yield _batch([close()], schema)
        if first:
            yield _batch([(part, -1, first, b"", b"", counts.tobytes())], schema)

    return run


def _encode_blocks(freq: np.ndarray, width: type):
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                        ("doc_ids", pa.binary()), ("lengths", pa.binary()), ("payload", pa.binary()),
                        ("states", pa.binary()), ("offsets", pa.binary()), ("crc", pa.int64())])

    def run(batches):
        coder, rows, held = Coder(freq) if freq.sum() else None, [], 0

        def flush():
            blocks = [np.frombuffer(r["ids"], width).astype(np.int32) for r in rows]
            done = coder.encode(blocks)
            return _batch([(r["part"], r["seq"], r["first"], len(b), r["doc_ids"], r["lengths"], *d,
                            zlib.crc32(b.astype("<u4").tobytes())) for r, b, d in zip(rows, blocks, done)], schema)

        for batch in batches:
            for row in batch.to_pylist():
                rows.append(row)
                held += len(row["ids"])
                if held >= 1 << 22:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    return run


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0) -> None:
    """Encode every whole text, append end_id to each document, and write the files in doc_id order."""
    spark = prepare(docs.sparkSession)
    source = id_and_text(docs)
    ordered = source.repartitionByRange(spread(source), "doc_id").sortWithinPartitions("doc_id", "text")
    ids = stored(ordered.mapInArrow(_gather(vocabulary, end_id), _ID_BLOCKS), "token-ids")
    size = encoder(vocabulary).tokenizer.get_vocab_size()

    def counted(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            for counts in batch.column("ids").to_pylist():
                total += np.frombuffer(counts, np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    counts = ids.where("seq = -1").select("ids").mapInArrow(counted, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    seen = counts.collect()  # the vocabulary bounds these rows
    total = np.zeros(size, np.int64)
    total[[r["id"] for r in seen]] = [r["n"] for r in seen]
    freq, _ = normalised(total) if total.sum() else (np.zeros(size, np.int64), 0)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(freq.tolist()) if f], "id int, frequency long").coalesce(1).write.parquet(f"{path}/frequencies")
    width = np.uint16 if size <= 1 << 16 else np.uint32
    ids.where("seq >= 0").mapInArrow(_encode_blocks(freq, width), _CODED).write.option("compression", "none").parquet(f"{path}/blocks")
    discard(ids)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned
    32-bit). Each block is decoded and checked by itself; only the partitions' totals pass the driver.
    """
    prepare(spark)
    freqs = spark.read.parquet(f"{path}/frequencies").collect()  # bounded by the vocabulary
    freq = np.zeros(1 + max((r["id"] for r in freqs), default=0), np.int64)
    for r in freqs:
        freq[r["id"]] = r["frequency"]
    blocks = spark.read.schema(_CODED).parquet(f"{path}/blocks")
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    offset, before = {}, 0
    for part, n in totals:  # one entry for each partition that wrote
        offset[part] = before
        before += n
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        coder, rows, held = Coder(freq) if freq.sum() else None, [], 0  # no frequencies: no blocks

        def flush():
            decoded = coder.decode([(r["payload"], r["states"], r["offsets"], r["n_ids"]) for r in rows])
            for r, ids in zip(rows, decoded):
                data = ids.astype("<u4").tobytes()
                if zlib.crc32(data) != r["crc"]:
                    raise ValueError(f"checksum of block {r['part']}/{r['seq']} does not hold")
                lengths = np.frombuffer(r["lengths"], np.int64)
                docs = np.frombuffer(r["doc_ids"], np.int64).reshape(-1, 2)
                ends = np.cumsum(lengths)
                starts = offset[r["part"]] + r["first"] + ends - lengths
                cells = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], ends]) * 4), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(docs[:, 0], mask=docs[:, 1] == 0), pa.array(starts),
                                                  pa.array(lengths), cells.cast(pa.binary())], schema=schema)

        for batch in batches:
            for row in batch.to_pylist():
                rows.append(row)
                held += row["n_ids"]
                if held >= 1 << 20:
                    yield from flush()
                    rows, held = [], 0
        if rows:
            yield from flush()

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, read back from the files: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    path = fresh_path(spark, "id-files")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
