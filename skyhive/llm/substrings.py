"""Exact substring dedup with difference-cover anchors.

Any run of WINDOW words that occurs twice is to be removed. Only windows of ANCHOR words that start at cover
positions (position in the document modulo PERIOD in COVER) are hashed. COVER holds every difference modulo
PERIOD, so for any two places of a long match there is an offset below PERIOD at which both are cover
positions: the match shares an aligned anchor. Around anchors that repeat, all windows of WINDOW words are
hashed (96 bits) and those that repeat are extended to the words they cover.

How rows move: a task hashes the texts of one flush, finds what repeats inside it, and sends one entry per
distinct hash to the hash's bucket, packed in arrays. So a passage in a third of all documents reaches its
bucket once per flush, not once per document. Buckets are sized by the bytes of all texts, whatever their
number. Answers go back to buckets of documents, where texts wait.

Defined results: words are [^\\x20\\x09-\\x0D]+; a null text has none; texts shorter than a window are kept;
rows with equal or null doc_ids are documents of their own; an empty table gives no rows; other columns are
passed through, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyhive.llm.common import discard, flushes, prepare, spans, stored, table, words_of

WINDOW, PERIOD, COVER = 35, 21, (3, 6, 7, 12, 14)
ANCHOR = WINDOW - PERIOD + 1
FLUSH, BUCKET = 12 << 20, 6 << 20

_PACKED = "bucket int, key binary, check binary, doc binary, tag binary, pos binary"
_PACKED_ARROW = [("bucket", pa.int32())] + [(c, pa.binary()) for c in ("key", "check", "doc", "tag", "pos")]


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def window_hashes(lane: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words, put together from runs of powers of two."""
    count = len(lane) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out, at, run, width = None, 0, lane, 1
    powers = {}
    while width <= size:
        powers[width] = run
        run, width = (mixed(run[:-width], run[width:]) if len(run) > width else run[:0]), 2 * width
    for width in sorted(powers, reverse=True):
        if size & width:
            part = powers[width][at:at + count]
            out, at = (part if out is None else mixed(out, part)), at + width
    return out


def lanes(words: pa.Array, seeds: tuple[int, ...]) -> list[np.ndarray]:
    coded = words.dictionary_encode()
    names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    digest = xxhash.xxh64_intdigest
    return [np.fromiter((digest(w, s) for w in names), np.uint64, len(names))[which] if len(names) else np.zeros(0, np.uint64) for s in seeds]


def _place(doc: np.ndarray, tag: np.ndarray, buckets: int) -> np.ndarray:
    return ((tag & 0xFFFFFFFF) * 1_000_003 ^ doc) % buckets


def _rows(bucket: np.ndarray, columns: list[np.ndarray | None]) -> list[tuple]:
    """One packed row per bucket; entries keep their order, so runs of a document stay together."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(bucket))
    columns = [None if c is None else c[order] for c in columns]
    return [(int(bucket[s]), *(None if c is None else c[s:e].tobytes() for c in columns)) for s, e in zip(starts.tolist(), ends.tolist())]


def _sent(key: np.ndarray, check: np.ndarray | None, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, buckets: int, kind: type) -> tuple[list, list]:
    """Packed entries for the hashes' buckets, and packed answers for what repeats right here.

    A hash that repeats here is sent once, without a place (pos -1): others learn of it, its places are answered.
    """
    order = np.argsort(key, kind="stable")
    k = key[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(k)))
    many = sizes > 1
    if check is not None and len(k):
        c = check[order]
        many &= np.minimum.reduceat(c, starts) == np.maximum.reduceat(c, starts)
    repeats = np.zeros(len(key), bool)
    repeats[order] = np.repeat(many, sizes)
    keep = ~repeats
    keep[order[starts[many]]] = True
    pos_sent = np.where(repeats, -1, pos).astype(np.int32)
    bucket = ((key[keep] >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    entries = _rows(bucket, [key[keep].astype(kind), None if check is None else check[keep], doc[keep], tag[keep], pos_sent[keep]])
    doc, tag, pos = doc[repeats], tag[repeats], pos[repeats]
    answers = [(b, None, None, d, t, p) for b, d, t, p in _rows(_place(doc, tag, buckets), [doc, tag, pos.astype(np.int32)])]
    return entries, answers


def _table(rows: list[tuple], names: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema(names)
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _identity(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """What names a row when answers come back: doc_id, and the text's CRC with a bit for a missing doc_id."""
    doc = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    crc = np.fromiter((zlib.crc32(t) for t in texts.cast(pa.large_binary()).to_pylist()), np.int64, len(texts))
    return doc, np.where(ids.is_null().to_numpy(zero_copy_only=False), crc | 1 << 32, crc)


def _anchors(buckets: int, window: int, period: int, cover: tuple[int, ...]):
    size = window - period + 1
    chosen = np.zeros(period, bool)
    chosen[list(cover)] = True

    def run(batches):
        for rows in flushes(batches, FLUSH):
            texts = rows.column("text")
            doc, tag = _identity(rows.column("doc_id"), texts)
            bounds, words = words_of(texts)
            hashes = window_hashes(lanes(words, (1,))[0], size)
            count = np.diff(bounds)
            count = np.where(count >= window, count - size + 1, 0)
            pos = spans(np.zeros(len(count), np.int64), count)
            owner = np.repeat(np.arange(len(count)), count)
            on = chosen[pos % period]
            pos, owner = pos[on], owner[on]
            entries, answers = _sent(hashes[bounds[owner] + pos], None, doc[owner], tag[owner], pos, buckets, np.uint32)
            yield _table(entries + answers, _PACKED_ARROW)

    return run


def _answered(buckets: int, kind: type, checked: bool):
    """All entries of one bucket to the places of hashes that occur more than once."""

    def run(rows: pa.Table) -> pa.Table:
        def column(name, dtype):
            return np.frombuffer(b"".join(rows.column(name).to_pylist()), dtype)

        key, doc, tag, pos = column("key", kind), column("doc", np.int64), column("tag", np.int64), column("pos", np.int32)
        if checked:
            check = column("check", np.uint32)
            order = np.lexsort((check, key))
            same = (key[order][1:] == key[order][:-1]) & (check[order][1:] == check[order][:-1])
        else:
            order = np.argsort(key, kind="stable")
            same = key[order][1:] == key[order][:-1]
        repeats = np.zeros(len(key), bool)
        repeats[order[1:][same]] = True
        repeats[order[:-1][same]] = True
        repeats &= pos >= 0
        doc, tag, pos = doc[repeats], tag[repeats], pos[repeats]
        answers = [(b, None, None, *rest) for b, *rest in _rows(_place(doc, tag, buckets), [doc, tag, pos])]
        return pa.Table.from_batches([_table(answers, _PACKED_ARROW)])

    return run


def _answers(sent: DataFrame, buckets: int, kind: type, checked: bool) -> DataFrame:
    entries = sent.where("key is not null").groupBy("bucket").applyInArrow(_answered(buckets, kind, checked), _PACKED)
    return sent.where("key is null").unionByName(entries)


def _marks(answers: pa.Table, doc: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, position) of all answers; every row of the same name gets them."""
    a_doc, a_tag, a_pos = (np.frombuffer(b"".join(answers.column(c).to_pylist()), d) for c, d in (("doc", np.int64), ("tag", np.int64), ("pos", np.int32)))
    name = mixed(doc.view(np.uint64), tag.astype(np.uint64))
    order = np.argsort(name, kind="stable")
    wanted = mixed(a_doc.view(np.uint64), a_tag.astype(np.uint64))
    low, high = np.searchsorted(name[order], wanted, "left"), np.searchsorted(name[order], wanted, "right")
    answer = np.repeat(np.arange(len(wanted)), high - low)
    row = order[spans(low, high - low)]
    true = (doc[row] == a_doc[answer]) & (tag[row] == a_tag[answer])
    return row[true], a_pos[answer[true]].astype(np.int64)


def _covered(n: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of n places lie in some [low, high)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, low, 1)
    np.add.at(change, high, -1)
    return np.cumsum(change[:-1]) > 0


def _lists(bounds: np.ndarray, words: pa.Array) -> pa.Array:
    """Words of each row joined by one space."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.cast(pa.large_string())), pa.scalar(" ", pa.large_string()))


def _windows(buckets: int, window: int, period: int):
    """Documents of one bucket with the anchors that repeat: their words, and packed windows around anchors."""
    size = window - period + 1

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        texts = docs.column("text").combine_chunks() if docs.num_rows else pa.array([], pa.string())
        ids = docs.column("doc_id").combine_chunks() if docs.num_rows else pa.array([], pa.int64())
        doc, tag = _identity(ids, texts)
        bounds, words = words_of(texts)
        row, pos = _marks(answers, doc, tag)
        count = np.diff(bounds)
        low = bounds[row] + np.maximum(0, pos - (window - size))
        high = bounds[row] + np.minimum(pos, count[row] - window) + 1
        place = np.flatnonzero(_covered(int(bounds[-1]) if len(bounds) else 0, low, np.maximum(low, high)))
        owner = np.searchsorted(bounds, place, "right") - 1
        rows = []
        if len(place):
            one, two = (window_hashes(x, window)[place] for x in lanes(words, (2, 3)))
            entries, back = _sent(one, (two >> np.uint64(32)).astype(np.uint32), doc[owner], tag[owner], place - bounds[owner], buckets, np.uint64)
            rows = entries + back
        touched = np.zeros(len(doc), bool)
        touched[owner] = True
        packed = _table(rows, _PACKED_ARROW)
        n, m = docs.num_rows, packed.num_rows
        columns = {"touched": pa.chunked_array([pa.array(touched), pa.nulls(m, pa.bool_())]),
                   "doc_id": pa.chunked_array([ids, pa.nulls(m, pa.int64())]),
                   "words": pa.chunked_array([_lists(bounds, words).cast(pa.string()), pa.nulls(m, pa.string())]),
                   "tag_of": pa.chunked_array([pa.array(tag), pa.nulls(m, pa.int64())]),
                   "n_words": pa.chunked_array([pa.array(count), pa.nulls(m, pa.int64())])}
        for name in (c for c in docs.column_names if c.startswith("other_")):
            kind = docs.schema.field(name).type
            columns[name] = pa.chunked_array([*docs.column(name).chunks, pa.nulls(m, kind)], kind)
        for name, kind in _PACKED_ARROW:
            columns[name] = pa.chunked_array([pa.nulls(n, kind), packed.column(name)])
        return pa.table(columns)

    return run


def _removed(window: int):
    """Documents of one bucket with the windows that repeat: the words that stay."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        n = docs.num_rows
        ids = docs.column("doc_id").combine_chunks() if n else pa.array([], pa.int64())
        doc = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        tag = docs.column("tag_of").to_numpy().astype(np.int64)
        bounds, words = words_of(docs.column("words").combine_chunks() if n else pa.array([], pa.string()))
        row, pos = _marks(answers, doc, tag)
        gone = _covered(int(bounds[-1]) if n else 0, bounds[row] + pos, bounds[row] + pos + window)
        before = np.concatenate([[0], np.cumsum(~gone)])
        kept = _lists(before[bounds], words.filter(pa.array(~gone)))
        left = np.diff(before[bounds])
        return pa.table({"doc_id": ids, "kept": kept.cast(pa.string()), "n_words": docs.column("n_words"),
                         "n_removed": pa.array(np.diff(bounds) - left), **{c: docs.column(c) for c in docs.column_names if c.startswith("other_")}})

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER) -> DataFrame:
    """doc_id, kept (the words that stay, joined by one space), n_words, n_removed, rest (other columns)."""
    spark = prepare(docs.sparkSession)
    others = {f"other_{i}": c for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))}
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
                       *(F.col(f"`{c}`").alias(o) for o, c in others.items()))
    size = base.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET))
    crc = F.crc32(F.encode("text", "UTF-8"))
    placed = base.withColumn("bucket", F.pmod((crc * 1_000_003).bitwiseXOR(F.coalesce("doc_id", F.lit(0).cast("long"))), F.lit(buckets)).cast("int"))
    kinds = "".join(f", {o} {base.schema[o].dataType.simpleString()}" for o in others)

    sent = stored(base.select("doc_id", "text").mapInArrow(_anchors(buckets, window, period, cover), _PACKED), "anchors")
    answers = stored(_answers(sent, buckets, np.uint32, False), "repeated-anchors")
    discard(sent)
    met = stored(placed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(
        _windows(buckets, window, period), f"touched boolean, doc_id long, words string, tag_of long, n_words long, {_PACKED}{kinds}"), "windows")
    discard(answers)
    again = stored(_answers(met.where("bucket is not null").select("bucket", "key", "check", "doc", "tag", "pos"), buckets, np.uint64, True), "repeated-windows")
    touched = met.where("touched").select("doc_id", "words", "tag_of", "n_words", *others,
                                          F.pmod((F.col("tag_of").bitwiseAND(0xFFFFFFFF) * 1_000_003).bitwiseXOR(F.coalesce("doc_id", F.lit(0).cast("long"))), F.lit(buckets)).cast("int").alias("bucket"))
    cut = touched.groupBy("bucket").cogroup(again.groupBy("bucket")).applyInArrow(
        _removed(window), f"doc_id long, kept string, n_words long, n_removed long{kinds}")
    whole = met.where("not touched").select("doc_id", F.col("words").alias("kept"), "n_words", F.lit(0).cast("long").alias("n_removed"), *others)
    rest = F.struct(*(F.col(o).alias(c) for o, c in others.items())) if others else F.lit(None).cast("string")
    return whole.unionByName(cut).select("doc_id", "kept", "n_words", "n_removed", rest.alias("rest"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    found = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
