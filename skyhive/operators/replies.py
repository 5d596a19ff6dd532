"""Model replies checked against the data they were given: parsing, matching, grounding, numbers, dispatch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyhive.operators.scale import latest

# Fixed values
LANGUAGES = ["en", "ta", "hi"]
AUDIENCES = ["authority", "citizen"]
URGENT_LEVELS = ["elevated", "urgent"]
URGENT_CATEGORIES = ["Very poor", "Severe"]
NO_SOURCE = "insufficient_signal"
ROUTINE = "routine"


def unfenced(text) -> Column:
    """The reply without a surrounding code fence."""
    raw = F.trim(F.col(text) if isinstance(text, str) else text)
    body = F.regexp_replace(F.regexp_replace(raw, r"(?s)^```[^\n]*\n", ""), r"(?s)```(?!.*```).*$", "")
    one_line = F.regexp_replace(raw, r"^`+|`+$", "")
    fenced = raw.startswith("```")
    return F.trim(F.when(fenced & raw.contains("\n"), body).when(fenced, one_line).otherwise(raw))


def parsed(df: DataFrame, text: str, schema: str, required: list[str], column: str = "data") -> DataFrame:
    """Adds `data` and `status`: ok, or unparseable when the text is no object or lacks a required key."""
    body = unfenced(text)
    names = F.json_object_keys(body)
    whole = F.try_parse_json(body).isNotNull() & body.startswith("{")
    complete = whole & F.forall(F.array(*[F.lit(r) for r in required]), lambda r: F.array_contains(names, r))
    good = F.coalesce(complete, F.lit(False))
    return (df.withColumn(column, F.when(good, F.from_json(body, schema)))
            .withColumn("status", F.when(good, "ok").otherwise("unparseable")))


def match_batch(asked: DataFrame, results: DataFrame, batch: str, item: str, required: list[str]) -> DataFrame:
    """Every asked item with its result: ok; missing_from_batch if it is absent or lacks a required key; or the
    batch's own status if the batch failed as a whole.

    asked: batch, item and `batch_status`. results: batch, item, `position` in the reply, a struct `result` and
    `keys`, the names present in it (a key with null is present). Of several results for one item the last
    counts. `unknown_ids` names items nobody asked for in that batch.
    """
    results = latest(results, [batch, item], ["position"])
    complete = F.forall(F.array(*map(F.lit, required)), lambda k: F.array_contains("keys", k))
    strays = (results.join(asked.select(batch, item), [batch, item], "left_anti")
              .groupBy(batch).agg(F.array_sort(F.collect_set(item)).alias("unknown_ids")))
    joined = asked.join(results.select(batch, item, "result", "keys"), [batch, item], "left").join(strays, batch, "left")
    ok = F.coalesce(complete, F.lit(False)) & (F.col("batch_status") == "ok")
    status = F.when(ok, "ok").when(F.col("batch_status") == "ok", "missing_from_batch").otherwise(F.col("batch_status"))
    return joined.withColumn("status", status).withColumn("result", F.when(ok, F.col("result"))).drop("keys", "batch_status")


def grounding_warnings(evidence, allowed: list[str], unknown_ids=None) -> Column:
    """One warning per cited signal that was not supplied, and one if the reply held foreign ids."""
    cited = F.col(evidence) if isinstance(evidence, str) else evidence
    allowed_names = F.array(*[F.lit(n) for n in allowed])
    foreign = F.filter(cited, lambda e: ~F.coalesce(F.array_contains(allowed_names, e["signal"]), F.lit(False)))
    lines = F.coalesce(F.transform(foreign, lambda e: F.concat(
        F.lit("evidence cites unknown signal '"), F.coalesce(e["signal"], F.lit("None")), F.lit("'"))),
        F.array().cast("array<string>"))
    if unknown_ids is None:
        return lines
    ids = F.col(unknown_ids)
    note = F.concat(F.lit("batch reply also contained unknown ids: "), F.array_join(ids, ", "))
    return F.when(F.coalesce(F.size(ids), F.lit(0)) > 0, F.concat(lines, F.array(note))).otherwise(lines)


def alert_facts(signals: str = "signals", attribution: str = "attribution") -> Column:
    """What an alert may say, with defaults where the attribution is silent."""
    s, a = (lambda f: F.col(f"{signals}.{f}")), (lambda f: F.col(f"{attribution}.{f}"))
    return F.struct(
        s("location.district").alias("district"), s("location.state").alias("state"), s("date").alias("date"),
        F.bround(s("predicted_pm25_ug_m3"), 0).cast("int").alias("predicted_pm25_ug_m3"),
        s("predicted_category").alias("predicted_category"), s("model_confidence").alias("model_confidence"),
        F.bround(s("prediction_typical_error_pct"), 0).cast("int").alias("typical_error_pct"),
        F.coalesce(a("dominant_source"), F.lit(NO_SOURCE)).alias("likely_source"),
        a("source_confidence").alias("source_confidence"), a("recommended_action").alias("recommended_action"),
        F.coalesce(a("urgency"), F.lit(ROUTINE)).alias("urgency"),
        a("uncertainty_statement").alias("uncertainty_statement"))


def number_check(value: Column, draft: str = "draft") -> Column:
    """One line per text of the draft that does not contain the predicted value."""
    shown = value.cast("string")
    lines = []
    for audience in AUDIENCES:
        for language in LANGUAGES:
            text = F.coalesce(F.col(f"{draft}.{audience}.{language}"), F.lit(""))
            lines.append(F.when(~text.contains(shown), F.concat(
                F.lit(f"{audience}.{language} is missing the predicted value "), shown)))
    return F.filter(F.array(*lines), lambda line: line.isNotNull())


def dispatch(drafts: DataFrame) -> DataFrame:
    """drafts: date, cell, status, facts -> whether each would be sent, and to whom.

    Drafts come from items with an attribution only; an item without one has no alert to send.
    """
    send = (F.col("status") == "ok") & F.col("facts.urgency").isin(URGENT_LEVELS)
    to = F.array(F.concat(F.lit("District Collector, "), F.col("facts.district")),
                 F.concat(F.col("facts.state"), F.lit(" Pollution Control Board")))
    return drafts.select("date", "cell", "status", F.col("facts.urgency").alias("urgency"),
                         F.coalesce(send, F.lit(False)).alias("would_send"), to.alias("authority_recipients"))


def urgency_violations(rows: DataFrame) -> DataFrame:
    """Attributions that break the urgency rule: urgent needs Very poor or worse and more than low confidence.

    rows: predicted_category, model_confidence, urgency.
    """
    urgent = F.col("urgency") == "urgent"
    weak = ~F.col("predicted_category").isin(URGENT_CATEGORIES) | (F.col("model_confidence") == "low")
    return rows.where(urgent & weak)
