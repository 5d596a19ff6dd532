"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests. DataFrame functions only.

A paragraph (line) is cut into pieces of 32, 64, 128, ... characters from its start, so an edit inside a long
paragraph leaves the pieces before it alone. A digest is a long: 40 bits of the piece's hash and 24 check bits
that follow from them. A sketch has three tables of cells; a digest is added to one cell of each, a cell holds
how many and the exclusive or of all. Two sketches subtract cell by cell; what both texts share cancels. A cell
with one digest left (count 1 or -1, check bits right) gives it away, it is taken out of its other two cells, and
so on (peeling). A pair that does not peel to nothing is sketched anew with GROWTH times the cells, until it does.

The cells of all pairs are rows; a pair's rows stay in one partition, so rounds of peeling are aggregates without
a shuffle. A round takes pure cells of one table only, so no digest is taken out twice.

Defined results: a null text is empty; its sketch is the empty string, and two empty texts are alike (1.0);
repeated pieces of a text count once; null doc_ids come first in the order, equal ones by text; of a single
document the next is itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyhive.llm.common import discard, id_and_text, prepare, stored, table

PIECE, CELLS, GROWTH, ROUNDS = 32, 48, 8, 5
PART_ROWS, PARTS = 2000, 2000
_CHECK = (1 << 24) - 1


def digests(text: Column) -> Column:
    """Distinct digests of the pieces of a text, an array of long."""
    def pieces(line):
        last = F.floor(F.log2(F.length(line) / float(PIECE) + 1 - 1e-9)).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(
            F.substr(line, (F.pow(F.lit(2.0), i).cast("int") - 1) * PIECE + 1, F.pow(F.lit(2.0), i).cast("int") * PIECE)))

    lines = F.filter(F.split(text, "\n"), lambda line: F.length(line) > 0)
    short = F.flatten(F.transform(lines, pieces))
    return F.array_distinct(F.transform(short, lambda h: _digest(F.shiftrightunsigned(h, 24))))


def _digest(key: Column) -> Column:
    return F.shiftleft(key, 24).bitwiseOR(F.xxhash64(key).bitwiseAND(F.lit(_CHECK)))


def _cells(digest: Column, cells: int, salt: int) -> list[Column]:
    """The digest's cell in each of the three tables."""
    third = cells // 3
    return [F.pmod(F.xxhash64(digest, F.lit(salt * 3 + t)), F.lit(third)).cast("int") + t * third for t in range(3)]


def sketch(sets: DataFrame, keys: list[str], cells: int = CELLS) -> DataFrame:
    """keys, sketch: the non-empty cells in order, each as cell (4 hex digits), count (8) and content (16).

    sets: the columns `keys` and `digests`. All rows of one key must lie in one partition for this not to shuffle.
    """
    rows = sets.select(*keys, F.explode("digests").alias("d"))
    rows = rows.select(*keys, "d", F.explode(F.array(*_cells(F.col("d"), cells, 0))).alias("cell"))
    filled = rows.groupBy(*keys, "cell").agg(F.count("*").alias("c"), F.bit_xor("d").alias("v"))
    text = F.concat(F.lpad(F.lower(F.hex("cell")), 4, "0"), F.lpad(F.lower(F.hex("c")), 8, "0"), F.lpad(F.lower(F.hex("v")), 16, "0"))
    return filled.select(*keys, text.alias("t")).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("t")), "").alias("sketch"))


def _peeled(pairs: DataFrame, cells: int, salt: int) -> DataFrame:
    """pair, cell, d, c, v after peeling: recovered digests have cell -1 and their side in c (1: left only)."""
    third = cells // 3
    side = lambda name, sign: F.transform(name, lambda d: F.struct(d.alias("v"), F.lit(sign).alias("c")))
    rows = pairs.repartition("pair").select("pair", F.explode(F.concat(side("left", 1), side("right", -1))).alias("e"))
    rows = rows.select("pair", F.col("e.v").alias("v"), F.col("e.c").alias("c")).select("pair", "c", "v", F.explode(F.array(*_cells(F.col("v"), cells, salt))).alias("cell"))
    left = rows.groupBy("pair", "cell").agg(F.sum("c").alias("c"), F.bit_xor("v").alias("v")).where("c <> 0 or v <> 0").select("pair", "cell", F.lit(0).cast("long").alias("d"), "c", "v")
    for step in range(3 * ROUNDS):
        t = step % 3
        places = _cells(F.col("v"), cells, salt)
        pure = ((F.col("cell") >= t * third) & (F.col("cell") < (t + 1) * third) & (F.abs("c") == 1)
                & (_digest(F.shiftrightunsigned("v", 24)) == F.col("v")) & (places[t] == F.col("cell")))
        row = lambda cell, d, c, v: F.struct(cell.cast("int").alias("cell"), d.cast("long").alias("d"), c.cast("long").alias("c"), v.cast("long").alias("v"))
        taken = F.array(row(F.lit(-1), F.col("v"), F.col("c"), F.lit(0)), *(row(p, F.lit(0), -F.col("c"), F.col("v")) for i, p in enumerate(places) if i != t))
        same = F.array(row(F.col("cell"), F.col("d"), F.col("c"), F.col("v")))
        left = left.select("pair", F.explode(F.when(pure, taken).otherwise(same)).alias("r")).select("pair", "r.*")
        left = left.groupBy("pair", "cell", "d").agg(F.sum("c").alias("c"), F.bit_xor("v").alias("v")).where("c <> 0 or v <> 0")
    return left


def differences(pairs: DataFrame, cells: int = CELLS) -> DataFrame:
    """What distinguishes two sets of digests, recovered from the difference of their sketches.

    pairs: pair (unique), left, right (arrays of digests). Returns pair, n_different for pairs that differ.
    Pairs that do not peel are tried again with more cells and other places; only their ids move between tries.
    """
    found, salt, waiting = None, 0, pairs
    while True:
        peeled = _peeled(waiting, cells, salt).groupBy("pair").agg(
            F.sum(F.when(F.col("cell") < 0, 1).otherwise(0)).alias("n_different"), F.max("cell").alias("stuck"))
        tried = stored(peeled, "peeled")
        done = tried.where("stuck < 0").select("pair", "n_different")
        found = done if found is None else found.unionByName(done)
        stuck = tried.where("stuck >= 0").select("pair")
        if stuck.isEmpty():
            return found
        waiting, cells, salt = pairs.join(stuck, "pair", "left_semi"), cells * GROWTH, salt + 1


def likeness(left: Column, right: Column, different: Column) -> Column:
    """Jaccard likeness of two sets from their sizes and the number of elements in one of them only."""
    both = (left + right - different) / 2
    return F.when(left + right == 0, 1.0).otherwise(both / (both + different))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text in ascending doc_id order; after the last comes the first.

    Rows go to ranges of doc_id (at most PARTS of them, cut at quantiles) and meet their successor inside; the last
    row of a range meets the first of the next by a small join.
    """
    n = docs.count()
    parts = max(1, min(PARTS, -(-n // PART_ROWS)))
    cuts = docs.agg(F.percentile_approx("doc_id", F.array(*(F.lit(i / parts) for i in range(1, parts))), 10_000)).first()[0] if parts > 1 and n else None
    cuts = sorted(set(cuts or []))
    part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("doc_id"))), F.lit(0)) if cuts else F.lit(0)
    placed = docs.withColumn("part", part.cast("int"))
    order = F.struct("doc_id", F.xxhash64("text"), "text")
    row = F.struct("doc_id", "text")
    ends = placed.groupBy("part").agg(F.min_by(row, order).alias("first"), F.max_by(row, order).alias("last"))
    present = sorted(r["part"] for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())
    after = {p: present[(i + 1) % len(present)] for i, p in enumerate(present)}
    inside = Window.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text")
    within = placed.withColumn("next_text", F.lead("text").over(inside)).where("next_text is not null").select("doc_id", "text", "next_text")
    if not present:
        return within
    follow = F.element_at(F.create_map(*(F.lit(x) for pair in after.items() for x in pair)), F.col("part"))
    lasts = ends.select(F.col("last"), follow.alias("part"))
    across = lasts.join(ends.select("part", F.col("first.text").alias("next_text")), "part").select("last.doc_id", "last.text", "next_text")
    return within.unionByName(across)


def compared(docs: DataFrame) -> DataFrame:
    """Each text beside its edited text (the last half of its characters replaced by the start of the next text).

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    prepare(docs.sparkSession)
    rows = with_next(id_and_text(docs))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
                       digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("changed"), digests(F.col("next_text")).alias("next"))
    sets = stored(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    pair = F.struct
    pairs = sets.select(F.explode(F.array(
        pair((F.col("row") * 2).alias("pair"), F.col("own").alias("left"), F.col("changed").alias("right")),
        pair((F.col("row") * 2 + 1).alias("pair"), F.col("own").alias("left"), F.col("next").alias("right")))).alias("p")).select("p.*")
    different = differences(pairs)
    different = different.select((F.shiftright("pair", 1)).alias("row"), F.col("pair").bitwiseAND(F.lit(1)).alias("which"), "n_different")
    different = different.groupBy("row").agg(*(F.sum(F.when(F.col("which") == w, F.col("n_different"))).alias(f"different_{w}") for w in (0, 1)))
    sided = sets.repartition("row").select("row", F.explode(F.array(pair(F.lit(0).alias("side"), F.col("own").alias("digests")), pair(F.lit(1).alias("side"), F.col("changed").alias("digests")))).alias("s"))
    prints = sketch(sided.select("row", "s.*"), ["row", "side"]).groupBy("row").agg(*(F.max(F.when(F.col("side") == s, F.col("sketch"))).alias(f"sketch_{s}") for s in (0, 1)))
    sizes = sets.select("row", "doc_id", "n_chars", "edited_sha256", *(F.size(c).alias(f"n_{c}") for c in ("own", "changed", "next")))
    full = sizes.join(prints, "row", "left").join(different, "row", "left")
    count = lambda w: F.coalesce(F.col(f"different_{w}"), F.lit(0))
    return full.select("doc_id", "n_chars", "edited_sha256", F.coalesce("sketch_0", F.lit("")).alias("fingerprint"), F.coalesce("sketch_1", F.lit("")).alias("edited_fingerprint"),
                       likeness(F.col("n_own"), F.col("n_changed"), count(0)).alias("near_edited"), likeness(F.col("n_own"), F.col("n_next"), count(1)).alias("near_next"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return compared(table(spark, sf_dir, "documents"))
