"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into blocks of 32 bits. If two fingerprints differ in at most 2 B - 1 of B blocks' bits,
some block of theirs differs in one bit at most. For each block the anchors are the words of a covering code:
the Hamming code of length 31 with one free bit, whose words lie within radius 1 of every block and within
radius 1 + 1 of any block in at most 17 places. Each fingerprint is sent to all anchors within covering radius
plus threshold (2) of its blocks, and marked as at home at the nearest; of two blocks one bit apart, one's
home is always among the other's anchors. Members of an anchor are compared with those at home there.

Why blocks: one code over 64 bits would send a fingerprint to thousands of anchors at radius 1, or compare
nearly everything at a large radius. Two blocks make 34 rows, each anchor's address has 27 bits.

Only distinct fingerprints take part, so copies cost nothing. An anchor's linked pairs are reduced to a
spanning forest where they are found; an anchor with more than CROWD members is dealt out as pairs of its
parts. Nothing is capped.

Near copies by the likeness of shingle sets (`without_copies`) check these links on the sets, and add bands of MinHash
values for pairs whose fingerprints differ in more bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyhive.llm.common import discard, id_and_text, prepare, spans, stored, table
from skyhive.llm.components import components

CROWD = 2048
_PAIRS = [(i, i ^ s) for s in range(1, 32) for i in range(1, 32) if i < i ^ s and i != s]  # two flips that undo syndrome s
_FLIPS = np.zeros((32, 16), np.uint32)  # by syndrome: the masks of one and of two flips that lead to a code word
for _s in range(1, 32):
    _FLIPS[_s] = [1 << (_s - 1), *(1 << (i - 1) | 1 << (j - 1) for i, j in _PAIRS if i ^ j == _s)]
_FREE = np.uint32(1 << 31)


def shingle_hashes(text: bytes, words: int, seed: int = 42) -> bytes:
    """XXH64 of all word shingles, eight bytes each, most significant first. `text` is lower-cased before."""
    parts = text.split()
    if not parts:
        return b""
    line = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    last = ends[min(words, len(parts)) - 1:][:n]
    digest = xxhash.xxh64_digest
    return b"".join([digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())])


def fingerprint(hashes: bytes, width: int = 8) -> np.ndarray:
    """Majority bits of hashes of `width` bytes: 1 if set in over half of them. No hashes: all zero."""
    if not hashes:
        return np.zeros(width, np.uint8)
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, width), axis=1)
    total = np.zeros(8 * width, np.int64)
    for i in range(0, len(bits), 255):  # sums of up to 255 rows fit a byte
        total += bits[i:i + 255].sum(0, dtype=np.uint8)
    return np.packbits(2 * total > len(bits))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and the 64-bit SimHash of a whole text's word shingles, repeats included."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])

    def run(batches):
        for batch in batches:
            prints = [fingerprint(shingle_hashes(t.encode().lower(), words, seed)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.frombuffer(b"".join(prints), ">i8").astype(np.int64))], schema=schema)

    prepare(docs.sparkSession)
    return id_and_text(docs).mapInArrow(run, "doc_id long, print long")


def anchors(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 32-bit blocks: (index into blocks, anchor, at home) of all anchors within radius 2."""
    syndrome = np.zeros(len(blocks), np.int64)
    for i in range(1, 32):
        syndrome ^= np.where(blocks >> np.uint32(i - 1) & np.uint32(1), i, 0)
    off = np.flatnonzero(syndrome)
    near = blocks ^ _FLIPS[syndrome, 0]  # a code word is its own nearest
    far = (blocks[off, None] ^ _FLIPS[syndrome[off], 1:]).reshape(-1)
    index = np.concatenate([np.arange(len(blocks)), np.arange(len(blocks)), np.repeat(off, 15)])
    return index, np.concatenate([near, near ^ _FREE, far]), np.arange(len(index)) < len(blocks)


def _dealt(nodes: DataFrame, n_blocks: int, carried: list[str]) -> DataFrame:
    """nodes (node, blocks binary, carried longs) sent to their anchors: key, home, node, carried."""
    names = ["key", "home", "node", *carried]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks = np.frombuffer(b"".join(batch.column("blocks").to_pylist()), ">u4").astype(np.uint32).reshape(-1, n_blocks)
            for b in range(n_blocks):
                index, anchor, home = anchors(blocks[:, b].copy())
                take = pa.array(index)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64) | b << 32), pa.array(home), batch.column("node").take(take),
                                                  *(batch.column(c).take(take) for c in carried)], names=names)

    kinds = ", ".join(f"{c} long" for c in carried)
    return nodes.mapInArrow(run, "key long, home boolean, node long" + (f", {kinds}" if kinds else ""))


def compared(node: np.ndarray, carried: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Spanning links between rows `left` and rows `right` of one anchor that differ in few enough bits.

    Parts join their nearest neighbour first (Boruvka), so links are as close as can be.
    """
    n, carried = len(node), carried.astype(np.uint64)  # bitwise_count takes the size of signed numbers
    apart = np.full((n, n), 255, np.uint8)
    for i in left.tolist():
        apart[i, right] = np.minimum(np.bitwise_count(carried[right] ^ carried[i]).sum(1, dtype=np.int64), 255)
    apart = np.minimum(apart, apart.T)
    np.fill_diagonal(apart, 255)
    apart[apart > threshold] = 255
    label, found = np.arange(n), []
    while True:
        other = apart.argmin(1)
        least = apart[np.arange(n), other].astype(np.int64)
        order = np.lexsort((np.arange(n), least, label))  # the nearest link out of each part
        first = order[np.concatenate([[True], label[order][1:] != label[order][:-1]])]
        first = first[least[first] < 255]
        if not len(first):
            return found
        parent = {}

        def root(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i in first.tolist():
            a, b = root(int(label[i])), root(int(label[other[i]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((node[i], node[other[i]]))
        label = np.array([root(int(x)) for x in label])
        apart[label[:, None] == label[None, :]] = 255


def _small(key: np.ndarray, home: np.ndarray, node: np.ndarray, carried: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """The same for many small anchors at once; rows are sorted by key."""
    carried = carried.astype(np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    group = np.repeat(np.arange(len(starts)), sizes)
    at = np.flatnonzero(home & (sizes[group] > 1))
    left = np.repeat(at, sizes[group[at]])
    right = spans(starts[group[at]], sizes[group[at]])
    apart = np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(carried[left[i:i + (1 << 20)]] ^ carried[right[i:i + (1 << 20)]]).sum(1, dtype=np.int64)
                                                     for i in range(0, len(left), 1 << 20))])
    near = np.flatnonzero((apart <= threshold) & (left != right))
    near = near[np.argsort(apart[near], kind="stable")]  # nearest first
    left, right = left[near], right[near]
    found, parent = [], {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in zip(left.tolist(), right.tolist()):  # row numbers, so anchors do not mix
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            found.append((node[i], node[j]))
    return found


def _compare(carried: list[str], threshold: int, crowd: int):
    """Sorted rows of whole anchors to links; a crowded anchor is passed on in numbered parts, one packed row each."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("part", pa.int32()), ("packed", pa.binary())])

    def links(found):
        pairs = np.unique(np.array([(min(x), max(x)) for x in found], np.int64).reshape(-1, 2), axis=0)
        n = len(pairs)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())] + [pa.nulls(n, f.type) for f in list(schema)[2:]], schema=schema)

    def run(batches):
        held: list[np.ndarray] = []  # rows of the last anchor met, as columns of long
        crowded, part = None, 0

        def columns(batch):
            return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "home", "node", *carried)])

        def passed(rows):
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([int(rows[0, 0])], pa.int64()),
                                               pa.array([part], pa.int32()), pa.array([rows[1:].tobytes()], pa.binary())], schema=schema)

        def finish(rows):
            nonlocal crowded, part
            key = rows[0]
            if crowded is not None:
                mine = int(np.searchsorted(key, crowded, side="right"))
                if mine:
                    yield passed(rows[:, :mine])
                crowded, part, rows = None, 0, rows[:, mine:]
                key = rows[0]
            if not rows.shape[1]:
                return
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.append(starts, len(key)))
            big = sizes > 64
            data = rows[3:].T
            found = []
            few = np.repeat(~big, sizes)
            if few.any():
                found += _small(key[few], rows[1][few].astype(bool), rows[2][few], data[few], threshold)
            for s, n in zip(starts[big].tolist(), sizes[big].tolist()):
                found += compared(rows[2][s:s + n], data[s:s + n], np.flatnonzero(rows[1][s:s + n]), np.arange(n), threshold)
            if found:
                yield links(found)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.concatenate([*held, columns(batch)], axis=1) if held else columns(batch)
            cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last anchor may go on
            if cut:
                yield from finish(rows[:, :cut])
                rows = rows[:, cut:]
            while rows.shape[1] > crowd:
                if crowded is None:
                    crowded, part = rows[0, -1], 0
                yield passed(rows[:, :crowd])
                part, rows = part + 1, rows[:, crowd:]
            held = [rows]
        if held:
            yield from finish(held[0])

    return run, "a long, b long, key long, part int, packed binary"


def _shared(batches):
    """Sorted rows of whole anchors, without anchors that hold one node or no home."""
    held: pa.Table | None = None

    def some(rows: pa.Table):
        key = rows.column("key").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        homes = np.add.reduceat(rows.column("home").to_numpy(zero_copy_only=False).astype(np.int64), starts)
        return rows.filter(pa.array(np.repeat((sizes > 1) & (homes > 0), sizes)))

    crowded = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        key = rows.column("key").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))
        if crowded is not None and key[0] == crowded:  # the rest of an anchor whose first rows were passed on
            mine = int(np.searchsorted(key, crowded, side="right"))
            yield from rows.slice(0, mine).to_batches()
            rows, cut = rows.slice(mine), max(0, cut - mine)
        if cut:
            yield from some(rows.slice(0, cut)).to_batches()
            rows = rows.slice(cut)
        if rows.num_rows > 1 << 16:
            crowded = key[-1]
            yield from rows.to_batches()
            rows = rows.slice(0, 0)
        held = rows if rows.num_rows else None
    if held is not None:
        yield from (held if crowded is not None and held.column("key")[0].as_py() == crowded else some(held)).to_batches()


def links(nodes: DataFrame, n_blocks: int, carried: list[str], threshold: int, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that join all nodes whose `carried` bits differ in at most `threshold`, among those with a
    block in common up to one bit. nodes: node long, blocks binary (n_blocks of 32 bits), carried longs.

    What is carried weighs on every row; beyond one long it meets the rows after lone ones are gone."""
    if len(carried) == 1:
        dealt = _dealt(nodes, n_blocks, carried)
    else:
        few = _dealt(nodes, n_blocks, []).repartition("key").sortWithinPartitions("key").mapInArrow(_shared, "key long, home boolean, node long")
        dealt = stored(few, "shared-anchors").join(nodes.select("node", *carried), "node").select("key", "home", "node", *carried)
    run, schema = _compare(carried, threshold, crowd)
    ordered = dealt.repartition("key").sortWithinPartitions("key")
    met = stored(ordered.mapInArrow(run, schema), "anchor-links")
    crowds = met.where("key is not null").select("key", "part", "packed")
    parts = crowds.groupBy("key").agg((F.max("part") + 1).alias("parts"))
    paired = (crowds.join(parts, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}))

    def across(batches):
        held: list[pa.RecordBatch] = []

        def pair(rows: pa.Table):
            low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
            parts = {p: np.frombuffer(c, np.int64).reshape(2 + len(carried), -1) for p, c in zip(rows.column("part").to_pylist(), rows.column("packed").to_pylist())}
            whole = parts[low] if low == high else np.concatenate([parts[low], parts[high]], axis=1)
            home, node, data = whole[0].astype(bool), whole[1], whole[2:].T
            one = np.arange(parts[low].shape[1])
            two = one if low == high else np.arange(len(one), whole.shape[1])
            found = compared(node, data, one[home[one]], two, threshold)
            if low != high:
                found += compared(node, data, two[home[two]], one, threshold)
            pairs = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        def groups(rows: pa.Table):
            mark = np.stack([rows.column(c).to_numpy() for c in ("key", "low", "high")], axis=1)
            return np.flatnonzero(np.concatenate([[True], (mark[1:] != mark[:-1]).any(1)]))

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch])
            starts = groups(rows)
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                yield pair(rows.slice(s, e - s))
            held = rows.slice(int(starts[-1])).to_batches()  # at most two parts
        if held:
            yield pair(pa.Table.from_batches(held))

    far = paired.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(across, "a long, b long")
    return met.where("key is null").select("a", "b").unionByName(far)


def near_duplicates(docs: DataFrame, words: int = 3, threshold: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, print (64-bit SimHash) and component_id, the smallest doc_id linked at `threshold` bits or fewer.

    Complete for thresholds up to 3 (two blocks). Defined results: a null or empty text has print zero, linked
    like any other; equal texts share a component; rows without doc_id keep their print, take no part in links
    and have a null component; equal doc_ids keep their rows; an empty table gives no rows.
    """
    if threshold > 3:
        raise ValueError("two blocks of a 64-bit fingerprint cover thresholds up to 3")
    prints = stored(fingerprints(docs, words, seed), "prints")
    nodes = stored(prints.where("doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("node")), "distinct-prints")
    sent = nodes.select("node", F.unhex(F.lpad(F.hex("print"), 16, "0")).alias("blocks"), "print")
    roots = components(links(sent, 2, ["print"], threshold))
    placed = nodes.join(roots, "node", "left").select("print", F.coalesce("root", "node").alias("component_id"))
    with_id = prints.where("doc_id is not null").join(placed, "print")
    return with_id.select("doc_id", "print", "component_id").unionByName(
        prints.where("doc_id is null").select("doc_id", "print", F.lit(None).cast("long").alias("component_id")))


def shingle_set(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.frombuffer(shingle_hashes(text, words), ">u8"))


BANDS, BAND_ROWS = 32, 4
_FACTORS = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b"factor", i) for i in range(BANDS * BAND_ROWS // 2)), np.uint64) | np.uint64(1)
_OFFSETS = np.frombuffer(b"".join(xxhash.xxh3_128_digest(b"offset", i) for i in range(BANDS * BAND_ROWS // 2)), np.uint64)
PART, PART_BYTES = 1024, 4 << 20
PRINT_WORDS = 3  # shingles of the fingerprints, as in near_duplicates


def band_keys(shingles: np.ndarray) -> bytes:
    """MinHash of a set of shingle hashes: for each band eight bytes that stand for its BAND_ROWS least values."""
    least = np.full(BANDS * BAND_ROWS, np.uint64(2 ** 64 - 1))
    values = shingles.astype(np.uint64)
    for i in range(0, len(values), 2048):
        np.minimum(least, ((values[i:i + 2048, None] ^ _OFFSETS) * _FACTORS).min(0), out=least)
    rows = least.tobytes()
    return b"".join(xxhash.xxh64_digest(rows[i:i + 8 * BAND_ROWS], i) for i in range(0, len(rows), 8 * BAND_ROWS))


def _prints_of_copies(words: int):
    names = ["row_a", "row_b", "doc_id", "same_a", "same_b", "size", "bands", "print"]

    def run(batches):
        for batch in batches:
            same, sizes, bands, prints = [], [], [], []
            for t in batch.column("text").to_pylist():
                text = t.encode().lower()
                same.append(xxhash.xxh3_128_digest(b" ".join(text.split())))
                shingles = shingle_set(text, words)
                sizes.append(len(shingles))
                bands.append(band_keys(shingles))
                prints.append(fingerprint(shingle_hashes(text, PRINT_WORDS)).tobytes())
            twin = np.frombuffer(b"".join(same), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_a"), batch.column("row_b"), batch.column("doc_id"), pa.array(twin[:, 0].copy()), pa.array(twin[:, 1].copy()),
                 pa.array(sizes, pa.int64()), pa.array(bands, pa.binary()),
                 pa.array(np.frombuffer(b"".join(prints), ">i8").astype(np.int64))], names=names)

    return run


def _banded(batches):
    for batch in batches:
        keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), ">i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column("node").to_numpy(), BANDS))], names=["key", "node"])


def _shingle_sets(words: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.encode().lower(), words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _alike(similarity: float):
    def run(batches):
        for batch in batches:
            good = []
            for a, b in zip(batch.column("of_a").to_pylist(), batch.column("of_b").to_pylist()):
                a, b = np.frombuffer(a, ">u8"), np.frombuffer(b, ">u8")
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(both >= similarity * (len(a) + len(b) - both) - 1e-9)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return run


def joined_by_sets(node: np.ndarray, label: np.ndarray, sets: list[np.ndarray], similarity: float, split: int = 0) -> list[tuple[int, int]]:
    """Links that join all rows whose sets are alike. label: what verified links already join; such pairs are the
    only ones left out. With `split`, rows before it are held against those from it on."""
    n, sizes = len(node), np.array([len(s) for s in sets], np.int64)
    label = np.unique(label, return_inverse=True)[1]
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    holder = np.repeat(np.arange(n), sizes)[order]  # rows by shingle
    starts = np.searchsorted(code[order], np.arange(code.max() + 2 if len(code) else 1))
    bounds, found = np.concatenate([[0], np.cumsum(sizes)]), []
    for i in range(split or n):
        apart = label != label[i]
        apart[:split or i] = False
        if not apart.any():
            continue
        mine = code[bounds[i]:bounds[i + 1]]
        both = np.bincount(holder[spans(starts[mine], starts[mine + 1] - starts[mine])], minlength=n)
        for j in np.flatnonzero(apart & (both >= similarity * (sizes[i] + sizes - both) - 1e-9)).tolist():
            if label[j] != label[i]:
                found.append((int(node[i]), int(node[j])))
                label[label == label[j]] = label[i]
    return found


def _parts_joined(similarity: float):
    """Rows key, low, high, part, members, sorted by the first three: links within a part, or between two."""

    def members(rows, at):
        one = rows.column("members").combine_chunks() if isinstance(rows, pa.Table) else rows.column("members")
        one = one.slice(at, 1).flatten()
        return (one.field("node").to_numpy(), one.field("label").to_numpy(), [np.frombuffer(x, ">u8") for x in one.field("shingles").to_pylist()])

    def run(batches):
        held = None  # first of two parts
        for batch in batches:
            found, rows = [], [batch.column(c).to_pylist() for c in ("key", "low", "high")]
            for at, mark in enumerate(zip(*rows)):
                mine = members(batch, at)
                if mark[1] == mark[2]:
                    found += joined_by_sets(*mine, similarity)
                elif held is not None and held[0] == mark:
                    first = held[1]
                    found += joined_by_sets(np.concatenate([first[0], mine[0]]), np.concatenate([first[1], mine[1]]), first[2] + mine[2], similarity, len(first[0]))
                    held = None
                else:
                    held = mark, mine
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    return run


def links_of_prints(nodes: DataFrame, threshold: int = 3) -> DataFrame:
    """Links (a, b) that join all nodes (node, print) whose fingerprints differ in at most `threshold` bits, by covering."""
    firsts = stored(nodes.groupBy("print").agg(F.min("node").alias("node")), "distinct-prints")
    sent = firsts.select("node", F.unhex(F.lpad(F.hex("print"), 16, "0")).alias("blocks"), "print")
    equal = nodes.join(firsts.select("print", F.col("node").alias("b")), "print").where("node <> b").select(F.col("node").alias("a"), "b")
    return links(sent, 2, ["print"], threshold).unionByName(equal)


def links_of_sets(nodes: DataFrame, sets_of, similarity: float, part: int = PART) -> DataFrame:
    """Links (a, b) that join all nodes linked by fingerprints or sharing a band, whose sets are alike. nodes: node, size,
    bands, print; sets_of(nodes) gives node and shingles.

    SimHash links are candidates first; bands add pairs whose fingerprints lie further apart than covering reaches.

    First every member of a band's key is held against the smallest one. Keys whose members these verified links
    do not join wholly are then searched for all links between what is still apart, a large one in pairs of parts.
    """
    banded = nodes.select("node", "bands").mapInArrow(_banded, "key long, node long")
    least = banded.groupBy("key").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1").select("key", "centre")
    shared = stored(banded.join(least, "key"), "shared-bands")
    printed = stored(links_of_prints(nodes.select("node", "print")).select("a", "b"), "print-links")
    ends = shared.select("node").unionByName(printed.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    sets = stored(sets_of(ends), "shingle-sets")
    banded_pairs = shared.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b"))
    near = stored(printed.unionByName(banded_pairs).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near")
    sided = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    true = stored(sided.select("a", "b", "of_a", "of_b").mapInArrow(_alike(similarity), "a long, b long"), "verified")
    placed = (shared.select("key", "node").join(components(true), "node", "left").select("key", "node", F.coalesce("root", "node").alias("label"))
              .join(nodes.select("node", "size"), "node"))
    open_keys = (placed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("weight"), F.min("label").alias("l"), F.max("label").alias("h"),
                                           F.bit_xor(F.xxhash64("node")).alias("x"), F.sum(F.xxhash64("node", F.lit(1)).cast("decimal(38,0)")).alias("y"))
                 .where("n > 2 and l <> h").groupBy("n", "weight", "x", "y").agg(F.min("key").alias("key")))  # bands with the same members count once
    parts = F.greatest(F.ceil(F.col("n") / part), F.ceil(8 * F.col("weight") / PART_BYTES)).cast("int")
    left = stored(placed.join(open_keys.select("key", parts.alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")), "open-bands")
    packed = left.join(sets, "node").groupBy("key", "parts", "part").agg(F.collect_list(F.struct("node", "label", "shingles")).alias("members"))
    paired = (packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
              .select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "members"))
    more = paired.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_parts_joined(similarity), "a long, b long")
    found = stored(true.unionByName(more), "set-links")
    discard(shared, printed, sets, near, left)
    return found


def without_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near copies (Jaccard of word shingles), that with the smallest doc_id.

    Candidates are the SimHash links of near_duplicates (three-word shingles, 3 bits), and, for pairs further apart, rows that
    share one of 32 bands of four MinHash values of their shingle sets: a pair at similarity s is missed with probability
    (1 - s^4)^32, 5e-8 at 0.8, wherever its differences sit. All links are verified on the sets.
    Rows without doc_id go before those with one. All columns pass through.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    key_a, key_b = F.xxhash64("doc_id", text), F.xxhash64(text, F.lit(7), "doc_id")
    rows = docs.select(key_a.alias("row_a"), key_b.alias("row_b"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    prints = stored(rows.mapInArrow(_prints_of_copies(words), "row_a long, row_b long, doc_id long, same_a long, same_b long, size long, bands binary, print long"), "prints")
    # one node for each text; its number is that of its first row
    first = F.min_by(F.struct("row_a", "row_b", "doc_id"), F.struct(F.coalesce("doc_id", F.lit(2 ** 63 - 1)), "row_a"))
    nodes = stored(prints.groupBy("same_a", "same_b", "size", "bands", "print").agg(first.alias("r")).select("size", "bands", "print", "r.*")
                   .withColumn("node", F.monotonically_increasing_id()), "nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        ends = wanted.join(nodes.select("node", "row_a", "row_b"), "node")
        found = rows.select("row_a", "row_b", "text").join(ends, ["row_a", "row_b"]).select("node", "text").mapInArrow(_shingle_sets(words), "node long, shingles binary")
        return found.groupBy("node").agg(F.first("shingles").alias("shingles"))

    roots = components(links_of_sets(nodes, sets_of, similarity))
    grouped = nodes.join(roots, "node", "left").withColumn("group", F.coalesce("root", "node"))
    best = grouped.groupBy("group").agg(F.min_by("node", F.struct(F.coalesce("doc_id", F.lit(2 ** 63 - 1)), "row_a")).alias("stays"))
    keepers = stored(grouped.join(best, "group").where(F.col("node") == F.col("stays")).select("row_a", "row_b"), "keepers")
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), key_a.alias("row_a"), key_b.alias("row_b"))
    again = prints.groupBy("row_a", "row_b").agg(F.count("*").alias("n")).where("n > 1").select("row_a", "row_b")
    kept = named.join(keepers, ["row_a", "row_b"], "left_semi")
    if again.isEmpty():
        return kept.select("doc.*")
    again = stored(again, "repeated-rows")  # rows alike in doc_id and text: one of them stays
    once = kept.join(again, ["row_a", "row_b"], "left_semi").groupBy("row_a", "row_b").agg(F.first("doc").alias("doc"))
    return kept.join(again, ["row_a", "row_b"], "left_anti").select("doc.*").unionByName(once.select("doc.*"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
