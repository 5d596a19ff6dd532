"""Quality and toxicity by hierarchical empirical Bayes.

Documents give evidence: a logistic model over shares of characters and repeated words (low quality), and the
weights of words and word beginnings that stand out in toxic documents (toxicity). Both are fitted on at most
LABELLED labelled rows, those with the smallest hashes of doc_id; that bound is the only one. Words are chosen
on two thirds of the sample and their weights calibrated on the rest. Evidence is a log likelihood ratio.

Sites give priors: over all documents the expected number of bad ones is summed per path (source and language)
and per host (source). A host's rate is shrunk to the global rate, a path's to its host's, with strengths
estimated from how much rates differ between sites beyond chance; a site with few documents keeps its parent's
rate. A document's posterior odds are its evidence times its path's odds. A document is rejected if it is more
likely bad than not on either account.

Defined results: a null text is empty; null sources and languages are sites of their own; labels that are null
or have no document are not used; without labels all evidence is zero and all documents stay; equal doc_ids are
judged row by row; an empty table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyhive.llm.common import discard, prepare, stored, table, words_of

LABELLED, LEXICON = 20_000, 2_000
BEGINNINGS = (4, 5, 6)  # characters
LEAST_RATE = 1e-4
_GROUPS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", string.digits, " ", "\n\r\t", ".,;:'\"()-", "!?", "#$%&*@^~+=", "|<>{}[]\\/_`"]
_BYTES = np.zeros((256, len(_GROUPS) + 1))
for _i, _g in enumerate(_GROUPS):
    _BYTES[[ord(c) for c in _g], _i] = 1
_BYTES[128:, -1] = 1
N_FEATURES = _BYTES.shape[1] + 7


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Feature rows, and the distinct words of each text as (text, index into words)."""
    n = len(texts)
    out = np.zeros((n, N_FEATURES))
    bounds, words = words_of(texts)
    count = np.diff(bounds)
    size = pc.binary_length(texts).to_numpy().astype(np.int64)
    for i, t in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        if t:
            out[i, :_BYTES.shape[1]] = np.bincount(np.frombuffer(t, np.uint8), minlength=256) @ _BYTES / len(t)
            lines = t.split(b"\n")
            out[i, -1] = 1 - len(set(lines)) / len(lines)
    plain = pc.utf8_trim(pc.utf8_lower(words.cast(pa.large_string())), string.punctuation).dictionary_encode()
    which, owner = plain.indices.to_numpy().astype(np.int64), np.repeat(np.arange(n), count)
    pair, times = np.unique(owner * max(1, len(plain.dictionary)) + which, return_counts=True)
    text, word = pair // max(1, len(plain.dictionary)), pair % max(1, len(plain.dictionary))
    per = np.maximum(count, 1)
    most = np.zeros(n)
    np.maximum.at(most, text, times)
    same = np.zeros(n)
    if len(which) > 1:
        np.add.at(same, owner[1:][(which[1:] == which[:-1]) & (owner[1:] == owner[:-1])], 1)
    at = _BYTES.shape[1]
    out[:, at] = np.bincount(text, minlength=n) / per
    out[:, at + 1] = np.where(count > 0, most / per, 0)
    out[:, at + 2] = same / per
    out[:, at + 3] = np.log1p(size)
    out[:, at + 4] = size / per
    out[:, at + 5] = np.minimum(out[:, at], np.bincount(text, minlength=n) / np.sqrt(per) / 10)
    return out, text, word, plain.dictionary


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: centre, scale, weights with the intercept last."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return centre, scale, w


def _logit(p):
    return np.log(p) - np.log1p(-p)


def forms(names: pa.Array) -> list[pa.Array]:
    """The words, and their beginnings marked by a caret."""
    caret, nothing = (pa.scalar(x, pa.large_string()) for x in ("^", ""))
    return [names, *(pc.binary_join_element_wise(caret, pc.utf8_slice_codeunits(names, 0, n), nothing) for n in BEGINNINGS)]


def toxic_scores(text: np.ndarray, word: np.ndarray, names: pa.Array, lexicon: dict[str, float], n: int) -> np.ndarray:
    """Per text: the sum of the weights of its listed words, whether it has any, and how many."""
    if not lexicon or not len(names):
        return np.zeros((n, 3))
    listed, weights = pa.array(list(lexicon), pa.large_string()), np.fromiter(lexicon.values(), float)
    weight = np.zeros(len(names))
    for form in forms(names):
        found = pc.index_in(form.cast(pa.large_string()), value_set=listed).fill_null(-1).to_numpy()
        weight = np.maximum(weight, np.where(found >= 0, weights[found], 0.0))
    hits = np.bincount(text, weights=weight[word] > 0, minlength=n)
    return np.column_stack([np.minimum(np.bincount(text, weights=weight[word], minlength=n), 30), hits > 0, np.minimum(hits, 8)])


def _linear(model, x: np.ndarray) -> np.ndarray:
    centre, scale, w = model
    return np.column_stack([(x - centre) / scale, np.ones(len(x))]) @ w


class Evidence:
    """What a text says by itself: log likelihood ratios of low quality and of toxicity."""

    def __init__(self, low, low_rate: float, toxic, toxic_rate: float, lexicon: dict[str, float]):
        self.low, self.low_rate, self.toxic, self.toxic_rate, self.lexicon = low, low_rate, toxic, toxic_rate, lexicon

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x, text, word, names = features(texts)
        low = np.zeros(len(texts)) if self.low is None else _linear(self.low, x) - _logit(self.low_rate)
        toxic = np.zeros(len(texts))
        if self.toxic is not None:
            toxic = _linear(self.toxic, toxic_scores(text, word, names, self.lexicon, len(texts))) - _logit(self.toxic_rate)
        return np.clip(low, -12, 12), np.clip(toxic, -12, 12)


def _lexicon_counts(batches):
    for batch in batches:
        _, text, word, names = features(batch.column("text").fill_null(""))
        toxic = batch.column("toxic").to_numpy().astype(float)
        for form in forms(names):
            coded = form.dictionary_encode()
            kinds = max(1, len(coded.dictionary))
            pair = np.unique(text * kinds + coded.indices.to_numpy().astype(np.int64)[word])
            n, k = np.bincount(pair % kinds, minlength=kinds), np.bincount(pair % kinds, weights=toxic[pair // kinds], minlength=kinds)
            if len(coded.dictionary):
                yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(n.astype(np.int64)), pa.array(k.astype(np.int64))], names=["word", "n", "k"])


def _feature_rows(lexicon: dict[str, float]):
    def run(batches):
        for batch in batches:
            x, text, word, names = features(batch.column("text").fill_null(""))
            x = np.column_stack([x, toxic_scores(text, word, names, lexicon, len(x))])
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("group"), batch.column("low"), batch.column("toxic"), batch.column("fold"), rows], names=["group", "low", "toxic", "fold", "x"])

    return run


def least_shingle(texts: pa.Array) -> pa.Array:
    """The smallest hash of three-word shingles: most near copies share it, so each group teaches once."""
    return pa.array([min((xxhash.xxh3_64_intdigest(b" ".join(w[i:i + 3])) for i in range(max(1, len(w) - 2))), default=0) >> 1
                     for w in (t.split() for t in texts.cast(pa.large_binary()).to_pylist())], pa.int64())


def learned(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[Evidence, float, float]:
    """The evidence function and the global rates of low quality and of toxicity. Of near copies the one with the smallest
    doc_id (then text) teaches, and rows are fitted in one order, so the model follows the rows and not their layout."""
    known = (labels.where("doc_id is not null and quality is not null and toxic is not null")
             .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled))  # bounded, so its ids may be sent to all tasks
    sample = stored(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("quality") < 1).cast("int").alias("low"), (F.col("toxic") > 0).cast("int").alias("toxic"))
        .withColumn("group", F.arrow_udf(least_shingle, "long")("text")).groupBy("group").agg(F.min(F.struct("doc_id", "text", "low", "toxic")).alias("r"))
        .select("group", "r.text", "r.low", "r.toxic").withColumn("fold", F.pmod(F.xxhash64("group"), F.lit(3)).cast("int")), "labelled")
    size = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("low"), F.lit(0)).alias("low"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    n, low, toxic = size["n"], size["low"], size["toxic"]
    rate = lambda k: (k + 1) / (n + 10)
    low_model, toxic_model, lexicon = None, None, {}
    if 0 < toxic < n:
        share = sample.where("fold > 0").agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        counts = sample.where("fold > 0").select("text", "toxic").mapInArrow(_lexicon_counts, "word string, n long, k long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        ratio = F.log((F.col("k") + 0.5) / (share[1] + 1)) - F.log((F.col("n") - F.col("k") + 0.5) / (share[0] - share[1] + 1))
        least = ratio - 2 * F.sqrt(1 / (F.col("k") + 0.5) + 1 / (F.col("n") - F.col("k") + 0.5))  # two standard errors below
        chosen = counts.where("k >= 3 and length(word) > 1").withColumn("weight", least).where("weight >= 1").orderBy(F.desc("weight"), "word").limit(LEXICON).collect()
        lexicon = {r["word"]: float(r["weight"]) for r in chosen}
    if 0 < low < n or lexicon:
        rows = sample.select("group", "text", "low", "toxic", "fold").mapInArrow(
            _feature_rows(lexicon), "group long, low int, toxic int, fold int, x array<double>").toPandas().sort_values("group")  # LABELLED rows at most, in one order
        x = np.stack(rows["x"].to_numpy())
        if 0 < low < n:
            low_model = fitted(x[:, :N_FEATURES], rows["low"].to_numpy().astype(float))
        if lexicon:
            y, rest = rows["toxic"].to_numpy().astype(float), rows["fold"].to_numpy() == 0
            if not 0 < y[rest].sum() < rest.sum():  # too few to keep apart
                rest = np.ones(len(y), bool)
            toxic_model = fitted(x[rest, N_FEATURES:], y[rest])
    discard(sample)
    return Evidence(low_model, low / n if n else 0.5, toxic_model, toxic / n if n else 0.5, lexicon), rate(low), rate(toxic)


def _strength(n: str, rate: str, parent: Column) -> Column:
    """How many documents a parent's rate is worth: by moments, from the spread of rates beyond chance."""
    spread = F.sum(F.col(n) * (F.col(rate) - parent) ** 2) - F.sum(parent * (1 - parent))
    weight = F.sum(n) - F.sum(F.col(n) * F.col(n)) / F.sum(n)
    variance = F.greatest(spread / F.greatest(weight, F.lit(1.0)), F.lit(1e-9))
    mean = F.sum(F.col(n) * parent) / F.sum(n)
    return F.least(F.greatest(mean * (1 - mean) / variance - 1, F.lit(2.0)), F.lit(1e6))


def site_rates(judged: DataFrame, rates: dict[str, float]) -> DataFrame:
    """source, lang and the shrunk rate of each kind of badness. judged: source, lang, p_<kind>."""
    paths = stored(judged.groupBy("source", "lang").agg(F.count("*").cast("double").alias("n"), *(F.sum(f"p_{k}").alias(f"k_{k}") for k in rates)), "paths")
    hosts = paths.groupBy("source").agg(F.sum("n").alias("host_n"), *(F.sum(f"k_{k}").alias(f"k_{k}") for k in rates))
    hosts = hosts.withColumns({f"raw_{k}": F.col(f"k_{k}") / F.col("host_n") for k in rates})
    total = hosts.agg(*(F.coalesce(_strength("host_n", f"raw_{k}", F.lit(r)), F.lit(1e6)).alias(k) for k, r in rates.items())).first()
    hosts = hosts.select("source", *(((F.col(f"k_{k}") + total[k] * r) / (F.col("host_n") + total[k])).alias(f"host_{k}") for k, r in rates.items()))
    paths = stored(paths.join(hosts, "source").select("source", "lang", "n", *(c for k in rates for c in (f"k_{k}", f"host_{k}"))), "path-hosts")
    raw = paths.withColumns({f"raw_{k}": F.col(f"k_{k}") / F.col("n") for k in rates})
    total = raw.agg(*(F.coalesce(_strength("n", f"raw_{k}", F.col(f"host_{k}")), F.lit(1e6)).alias(k) for k in rates)).first()
    return paths.select("source", "lang", *(F.greatest(F.lit(LEAST_RATE), F.least(F.lit(1 - LEAST_RATE), (F.col(f"k_{k}") + total[k] * F.col(f"host_{k}")) / (F.col("n") + total[k]))).alias(f"rate_{k}") for k in rates))


def judged(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """doc (all columns of the row as a struct), p_low, p_toxic, keep."""
    prepare(docs.sparkSession)
    evidence, low, toxic = learned(docs, labels, labelled)

    def of_text(texts: pa.Array) -> pa.Array:
        a, b = evidence(texts)
        return pa.StructArray.from_arrays([pa.array(a), pa.array(b)], names=["low", "toxic"])

    weigh = F.arrow_udf(of_text, "low double, toxic double")
    posterior = lambda llr, odds: 1 / (1 + F.exp(-(llr + odds)))
    text = F.coalesce(F.col("text"), F.lit(""))
    site = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(c) for c in ("source", "lang")]
    alone = docs.select(*site, weigh(text).alias("e")).select(
        "source", "lang", posterior(F.col("e.low"), F.lit(float(_logit(low)))).alias("p_low"), posterior(F.col("e.toxic"), F.lit(float(_logit(toxic)))).alias("p_toxic"))
    rates = site_rates(alone, {"low": low, "toxic": toxic})
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), *site, weigh(text).alias("e"))
    odds = {k: F.log(F.col(f"rate_{k}") / (1 - F.col(f"rate_{k}"))) for k in ("low", "toxic")}
    found = rows.join(rates, ["source", "lang"]).select("doc", *(posterior(F.col(f"e.{k}"), odds[k]).alias(f"p_{k}") for k in odds))
    return found.withColumn("keep", (F.col("p_low") < 0.5) & (F.col("p_toxic") < 0.5))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that are not rejected, with their columns."""
    return judged(docs, labels).where("keep").select("doc.*")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, p_low, p_toxic, keep for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return judged(docs, table(spark, sf_dir, "labels")).select("doc.doc_id", "p_low", "p_toxic", "keep")
