"""The live table, stored replies, reply checks, photo readings, signal packs, and tables written to disk."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyhive.functions import columns as C
from skyhive.functions.scales import aqi_category, pm25_class, pm25_label
from skyhive.operators import clean, live, packs, photos, replay, replies, rollup
from skyhive.operators import stations as ST
from skyhive.registry.adapters import RES, load, raw, sites
from skyhive.registry.book import register
from skyhive.registry.sqltext import aqi_label, cell_of, fixed6, fragment, haversine, query
from skyhive.registry.sqltext import pm25_class as sql_class
from skyhive.registry.sqltext import pm25_label as sql_label
from skyhive.session import cut_lineage, shared_path

# ---------------------------------------------------------------- live feed

fragment("live", """SELECT * FROM (SELECT 'state-' || substr(trim(state), 7) || '|' || lower(replace(trim(city), ' ', '-')) || '|stn-'
 || regexp_extract(station, '[0-9]+') AS station_id, trim(state) AS state, trim(city) AS city, station, TRY_CAST(latitude AS DOUBLE) AS latitude,
 TRY_CAST(longitude AS DOUBLE) AS longitude, date_trunc('second', ts) AS last_update, pollutant_id,
 TRY_CAST(coalesce(avg_value, pollutant_avg) AS DOUBLE) AS avg_value, line FROM feed) f
 QUALIFY row_number() OVER (PARTITION BY station_id, pollutant_id, last_update ORDER BY line DESC) = 1""", "feed")
_WIDE = {"PM2.5": "pm25", "PM10": "pm10", "NO2": "no2", "SO2": "so2", "CO": "co", "OZONE": "o3", "NH3": "nh3"}
fragment("live_wide", "SELECT station_id, max(last_update) AS last_update, arg_max(city, (last_update, line)) AS city, " + ", ".join(
    f"arg_max(avg_value, line) FILTER (pollutant_id = '{p}' AND avg_value IS NOT NULL) AS {c}" for p, c in _WIDE.items())
         + " FROM live GROUP BY station_id", "live")


def feed(spark, sf):
    """Feed records with their text time in India."""
    return load(spark, sf, "feed").withColumn("last_update", F.date_format(
        F.from_utc_timestamp("ts", C.IST), "dd-MM-yyyy HH:mm:ss")).drop("ts")


def live_long(spark, sf):
    return live.live_readings(feed(spark, sf), ["line"])


@register("live_readings", query("""SELECT station_id, state, city, station, round(latitude, 6) AS latitude, last_update, pollutant_id, avg_value FROM live""", "live"))
def live_readings(spark, sf):
    return live.live_readings(feed(spark, sf), ["line"]).select(
        "station_id", "state", "city", "station", F.round("latitude", 6).alias("latitude"), "last_update", "pollutant_id", "avg_value")


_TOP = "greatest(" + ", ".join(_WIDE.values()) + ")"
_N = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in _WIDE.values())


@register("live_table", query(f"""SELECT station_id, last_update, city, {', '.join(_WIDE.values())}, {_N} AS n_pollutants, {_TOP} AS aqi,
 CASE {' '.join(f"WHEN {c} = {_TOP} THEN '{c}'" for c in _WIDE.values())} END AS dominant_pollutant,
 {_N} >= 3 AND (pm25 IS NOT NULL OR pm10 IS NOT NULL) AS aqi_valid, {aqi_label(_TOP)} AS aqi_category FROM live_wide""", "live_wide"))
def live_table(spark, sf):
    table = live.live_table(live_long(spark, sf), ["line"])
    return table.select("station_id", "last_update", "city", *_WIDE.values(), "n_pollutants", "aqi", "dominant_pollutant",
                        "aqi_valid", "aqi_category")


@register("live_summary", query("""SELECT count(*) AS stations, (SELECT count(DISTINCT state) FROM live) AS states, count(*) FILTER (n >= 3 AND pm) AS valid_index
 FROM (SELECT """ + _N + " AS n, pm25 IS NOT NULL OR pm10 IS NOT NULL AS pm FROM live_wide) w", "live", "live_wide"))
def live_summary(spark, sf):
    return live.live_summary(live.live_table(live_long(spark, sf), ["line"]))


@register("value_scales", f"""SELECT event_id, {aqi_label('value')} AS aqi_category, {sql_label('round(value / 10) * 10')} AS shown,
 CAST({sql_class('round(value / 10) * 10')} AS INTEGER) AS scored FROM events""")
def value_scales(spark, sf):
    """Both category rules on values that often lie on an edge."""
    rows = spark.read.parquet(f"{sf}/events.parquet").withColumn("tens", F.round(F.col("value") / 10) * 10)
    return rows.select("event_id", aqi_category("value").alias("aqi_category"), pm25_label("tens").alias("shown"),
                       pm25_class("tens").alias("scored"))


# ---------------------------------------------------------------- stored replies

fragment("keyed", """SELECT *, sha256(to_json({'p0': model, 'p1': prompt_version, 'p2': endpoint, 'p3': lang, 'p4': text})::VARCHAR) AS key FROM requests""", "requests")
fragment("store", """SELECT key, min(model) AS model, min(prompt_version) AS prompt_version, min(doc_id) AS first_doc, CASE min(doc_id) % 4 WHEN 0
 THEN '{"error": {"code": 429}}' WHEN 1 THEN '{"candidates": []}' ELSE '{"candidates": [{"content": {"parts": [{"text": "' || min(doc_id) || '"}]}}]}' END AS response
 FROM keyed WHERE doc_id % 3 = 0 OR lang = 'en' GROUP BY key""", "keyed")


def keyed(spark, sf):
    return load(spark, sf, "requests").withColumn(
        "key", replay.request_key("model", "prompt_version", "endpoint", "lang", "text"))


def store(spark, sf):
    known = keyed(spark, sf).where("doc_id % 3 = 0 OR lang = 'en'").groupBy("key").agg(
        F.min("model").alias("model"), F.min("prompt_version").alias("prompt_version"), F.min("doc_id").alias("first_doc"))
    reply = (F.when(F.col("first_doc") % 4 == 0, F.lit('{"error": {"code": 429}}'))
             .when(F.col("first_doc") % 4 == 1, F.lit('{"candidates": []}'))
             .otherwise(F.concat(F.lit('{"candidates": [{"content": {"parts": [{"text": "'), F.col("first_doc").cast("string"),
                                 F.lit('"}]}}]}'))))
    return known.withColumn("response", reply)


@register("replayed_requests", query("""SELECT doc_id, k.key, response, CASE WHEN s.key IS NULL THEN 'offline_miss' ELSE 'hit' END AS outcome
 FROM keyed k LEFT JOIN store s USING (key)""", "keyed", "store"))
def replayed_requests(spark, sf):
    return replay.replay(keyed(spark, sf), store(spark, sf)).select("doc_id", "key", "response", "outcome")


@register("replay_outcomes", query("""SELECT CASE WHEN s.key IS NULL THEN 'miss' ELSE 'hit' END AS outcome, count(*) AS requests
 FROM keyed k LEFT JOIN store s USING (key) GROUP BY 1""", "keyed", "store"))
def replay_outcomes(spark, sf):
    return replay.outcome_counts(replay.replay(keyed(spark, sf), store(spark, sf), offline=False))


@register("missing_requests", query("SELECT DISTINCT key FROM keyed WHERE key NOT IN (SELECT key FROM store)", "keyed", "store"))
def missing_requests(spark, sf):
    return replay.missing_keys(keyed(spark, sf), store(spark, sf))


@register("store_stats", query("""SELECT model, prompt_version, count(*) AS entries, CAST(sum(length(response)) AS BIGINT) AS characters,
 count(*) FILTER (first_doc % 4 = 0) AS errors, count(*) FILTER (first_doc % 4 < 2) AS unusable FROM store GROUP BY ALL""", "store"))
def store_stats(spark, sf):
    return replay.store_stats(store(spark, sf))


@register("pruned_store", query("SELECT key, first_doc FROM store WHERE first_doc % 4 <> 0", "store"))
def pruned_store(spark, sf):
    return replay.prune_errors(store(spark, sf)).select("key", "first_doc")


@register("content_matches", """SELECT d.doc_id, sha256(d.text) AS sha256, k.id AS matched_id FROM documents d LEFT JOIN (SELECT sha256(text) AS sha256,
 min(doc_id) AS id FROM documents WHERE lang = 'en' GROUP BY 1) k ON k.sha256 = sha256(d.text)""")
def content_matches(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    known = docs.where("lang = 'en'").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("id"))
    return replay.match_by_content(docs.select("doc_id", "text"), known, "text").select("doc_id", "sha256", "matched_id")


# ---------------------------------------------------------------- photo readings

_PHOTO = ["doc_id AS id", "doc_id % 9 <> 4 AS sky_visible", "CASE WHEN doc_id % 23 <> 3 THEN CAST(n_chars % 131 - 10 AS INT) END AS haze_severity",
          "CAST(n_chars % 47 AS DOUBLE) / 2 AS visibility_km_estimate", "CASE WHEN doc_id % 31 <> 5 THEN CAST((n_chars % 13) AS DOUBLE) / 10 - 0.05E0 END AS confidence",
          "CAST(doc_id * 17 % 300 AS DOUBLE) AS pm25", "CASE WHEN doc_id % 29 <> 4 THEN CAST(doc_id * 5 % 90 AS DOUBLE) + 0.37E0 END AS uncertainty"]
fragment("photos", f"SELECT {', '.join(_PHOTO)} FROM documents")
_HAZE = "(CASE WHEN haze_severity IS NOT NULL THEN least(100, greatest(0, haze_severity)) END)"
_STEP = lambda *v: f"CASE WHEN haze_severity IS NULL THEN NULL WHEN {_HAZE} < 20 THEN {v[0]} WHEN {_HAZE} < 40 THEN {v[1]} WHEN {_HAZE} < 60 THEN {v[2]} WHEN {_HAZE} < 80 THEN {v[3]} ELSE {v[4]} END"
fragment("observed", f"""SELECT *, CASE WHEN sky_visible THEN 'ok' ELSE 'no_sky' END AS status, CASE WHEN sky_visible THEN {_STEP(0, 31, 61, 121, 251)} END AS pm25_low,
 CASE WHEN sky_visible THEN {_STEP(30, 60, 120, 250, 400)} END AS pm25_high, CASE WHEN sky_visible THEN visibility_km_estimate <= 2 AND {_HAZE} < 50 END AS consistency_warning,
 CASE WHEN sky_visible THEN round_even(CASE WHEN confidence IS NOT NULL THEN least(1.0, greatest(0.0, confidence)) END * CASE WHEN visibility_km_estimate <= 2 AND {_HAZE} < 50 THEN 0.2 ELSE 1.0 END, 2)
 ELSE 0.0 END AS effective_confidence FROM photos""", "photos")


def observed(spark, sf):
    return photos.observations(spark.read.parquet(f"{sf}/documents.parquet").selectExpr(*_PHOTO))


@register("photo_observations", query("""SELECT id, status, pm25_low, pm25_high, (pm25_low + pm25_high) / 2.0::DOUBLE AS pm25_mid, consistency_warning,
 effective_confidence::DOUBLE AS effective_confidence FROM observed""", "observed"))
def photo_observations(spark, sf):
    return observed(spark, sf).select("id", "status", "pm25_low", "pm25_high", "pm25_mid", "consistency_warning", "effective_confidence")


_SO = "((pm25_high - pm25_low) / 2.0 / greatest(effective_confidence, 0.05))"
_SP = "(CASE WHEN uncertainty IS NOT NULL THEN greatest(uncertainty, 1.0) END)"
_W = f"((1 / ({_SO} * {_SO})) / (1 / ({_SO} * {_SO}) + 1 / ({_SP} * {_SP})))"


@register("fused_estimates", query(f"""SELECT id, status, CASE WHEN effective_confidence > 0 AND pm25_low IS NOT NULL THEN round({_W} * (pm25_low + pm25_high) / 2.0
 + (1 - {_W}) * pm25, 1) ELSE pm25 END AS fused_pm25, CASE WHEN effective_confidence > 0 AND pm25_low IS NOT NULL THEN round(sqrt(1 / (1 / ({_SO} * {_SO}) + 1 / ({_SP} * {_SP}))), 1) END
 AS fused_uncertainty, CASE WHEN effective_confidence > 0 AND pm25_low IS NOT NULL THEN round({_W}, 3) ELSE 0.0::DOUBLE END AS photo_weight FROM observed""", "observed"))
def fused_estimates(spark, sf):
    seen = observed(spark, sf).withColumn("cell", F.col("id"))
    return photos.fused(seen.select("cell", "pm25", "uncertainty"), seen.drop("pm25", "uncertainty")).select(
        "id", "status", "fused_pm25", "fused_uncertainty", "photo_weight")


# ---------------------------------------------------------------- replies

# One reply text per document: fenced or not, sometimes cut short, without a field or with null in it, with an earlier
# result for the same item, or for an item nobody asked about.
_EVIDENCE = "'[{\"signal\": \"' || CASE WHEN doc_id % 4 = 0 THEN 'rumour' ELSE 'aerosol_index' END || '\"}, {\"signal\": \"location.state\"}]'"
_ID = "CAST(CASE WHEN doc_id % 10 = 9 THEN doc_id + 1000000 ELSE doc_id END AS STRING)"
_EARLIER = f"CASE WHEN doc_id % 13 = 6 THEN '{{\"hex_id\": \"h' || {_ID} || '\", \"dominant_source\": \"old\", \"urgency\": \"routine\", \"evidence\": []}}, ' ELSE '' END"
_BODY = ("'{\"results\": [' || " + _EARLIER + " || '{\"hex_id\": \"h' || " + _ID + " || '\", \"dominant_source\": \"'"
         " || CASE WHEN doc_id % 3 = 0 THEN 'dust' ELSE 'vehicular' END || '\", ' || CASE WHEN doc_id % 11 = 5 THEN '' WHEN doc_id % 17 = 8 THEN '\"urgency\": null, ' ELSE '\"urgency\": \"'"
         " || CASE doc_id % 3 WHEN 0 THEN 'urgent' WHEN 1 THEN 'elevated' ELSE 'routine' END || '\", ' END || '\"evidence\": ' || " + _EVIDENCE + " || '}]}'")
_REPLY = ["doc_id", "'h' || CAST(doc_id AS STRING) AS item", "lang AS batch_lang",
          f"CASE doc_id % 7 WHEN 0 THEN '```json' || chr(10) || {_BODY} || chr(10) || '```' WHEN 1 THEN 'sorry: ' || {_BODY} WHEN 2 THEN '{{\"other\": 1}}' ELSE {_BODY} END AS reply"]
fragment("reply_facts", """SELECT doc_id, 'h' || doc_id AS item, doc_id % 7 NOT IN (1, 2) AS parses, doc_id % 10 = 9 AS stray, doc_id % 11 = 5 AS no_urgency,
 CASE WHEN doc_id % 3 = 0 THEN 'dust' ELSE 'vehicular' END AS source, CASE WHEN doc_id % 17 <> 8 THEN CASE doc_id % 3 WHEN 0 THEN 'urgent' WHEN 1 THEN 'elevated' ELSE 'routine' END END AS urgency FROM documents""")
SHAPE = "results array<struct<hex_id:string,dominant_source:string,urgency:string,evidence:array<struct<signal:string>>>>"
ALLOWED = ["aerosol_index", "location", "location.state"]


def reply_rows(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(*_REPLY)
    return replies.parsed(rows, "reply", SHAPE, ["results"])


@register("parsed_replies", query("""SELECT doc_id, CASE WHEN parses THEN 'ok' ELSE 'unparseable' END AS status, CASE WHEN parses THEN CASE WHEN doc_id % 13 = 6 THEN 'old' ELSE source END END AS dominant_source FROM reply_facts""", "reply_facts"))
def parsed_replies(spark, sf):
    return reply_rows(spark, sf).select("doc_id", "status", F.col("data.results")[0]["dominant_source"].alias("dominant_source"))


def matched(spark, sf):
    rows = reply_rows(spark, sf)
    names = F.from_json(replies.unfenced("reply"), "results array<string>")["results"]
    results = rows.where("status = 'ok'").select("doc_id", F.posexplode(F.arrays_zip(F.col("data.results").alias("typed"), names.alias("raw"))).alias("position", "r"))
    results = results.select("doc_id", "position", F.col("r.typed").alias("result"), F.col("r.typed.hex_id").alias("item"), F.json_object_keys("r.raw").alias("keys"))
    return replies.match_batch(rows.select("doc_id", "item", F.col("status").alias("batch_status")), results, "doc_id", "item", ["dominant_source", "urgency", "evidence"])


@register("matched_replies", query("""SELECT doc_id, item, CASE WHEN NOT parses THEN 'unparseable' WHEN stray OR no_urgency THEN 'missing_from_batch' ELSE 'ok' END AS status,
 CASE WHEN parses AND stray THEN 'h' || (doc_id + 1000000) END AS unknown_ids, CASE WHEN parses AND NOT stray AND NOT no_urgency THEN urgency END AS urgency FROM reply_facts""", "reply_facts"))
def matched_replies(spark, sf):
    return matched(spark, sf).select("doc_id", "item", "status", F.array_join("unknown_ids", ",").alias("unknown_ids"), "result.urgency")


@register("grounding_warnings", query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'evidence cites unknown signal ''rumour''' ELSE '' END AS warnings FROM reply_facts
 WHERE parses AND NOT stray AND NOT no_urgency""", "reply_facts"))
def grounding_warnings(spark, sf):
    rows = matched(spark, sf).where("status = 'ok'")
    return rows.select("doc_id", F.array_join(replies.grounding_warnings(F.col("result.evidence"), ALLOWED, "unknown_ids"), ";").alias("warnings"))


_DRAFTED = ["doc_id", "CAST(n_chars % 300 AS INT) AS value", "lang", "CAST(n_chars AS STRING) || ' estimate' AS t1", "'level ' || CAST(n_chars % 300 AS STRING) AS t2"]


@register("number_checks", """SELECT doc_id, CASE WHEN NOT contains(CAST(n_chars AS VARCHAR), CAST(n_chars % 300 AS VARCHAR)) THEN 'authority.en is missing the predicted value ' || n_chars % 300 || ';' ELSE '' END
 || CASE WHEN lang <> 'en' AND NOT contains(CAST(n_chars AS VARCHAR), CAST(n_chars % 300 AS VARCHAR)) THEN 'citizen.hi is missing the predicted value ' || n_chars % 300 || ';' ELSE '' END AS checks FROM documents""")
def number_checks(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").selectExpr(*_DRAFTED)
    good, doubtful = F.col("t2"), F.col("t1")
    draft = F.struct(F.struct(doubtful.alias("en"), good.alias("ta"), good.alias("hi")).alias("authority"),
                     F.struct(good.alias("en"), good.alias("ta"), F.when(F.col("lang") == "en", good).otherwise(doubtful).alias("hi")).alias("citizen"))
    lines = replies.number_check(F.col("value"), "draft")
    return rows.withColumn("draft", draft).select("doc_id", F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit(";"))), "").alias("checks"))


@register("alert_dispatch", query("""SELECT doc_id, coalesce(urgency, 'routine') AS urgency, source AS likely_source, coalesce(urgency, 'routine') <> 'routine' AS would_send, 'District Collector, District ' || doc_id % 50 || ';State ' || doc_id % 5
 || ' Pollution Control Board' AS recipients, CAST(round_even((doc_id % 997) / 4.0, 0) AS INTEGER) AS predicted FROM reply_facts
 WHERE parses AND NOT stray AND NOT no_urgency""", "reply_facts"))
def alert_dispatch(spark, sf):
    rows = matched(spark, sf).where("status = 'ok'")  # items without an attribution have no alert
    signals = F.struct(F.lit("2024-01-05").alias("date"), F.struct(
        F.concat(F.lit("District "), (F.col("doc_id") % 50).cast("string")).alias("district"),
        F.concat(F.lit("State "), (F.col("doc_id") % 5).cast("string")).alias("state")).alias("location"),
        ((F.col("doc_id") % 997) / 4).alias("predicted_pm25_ug_m3"), F.lit("Poor").alias("predicted_category"),
        F.lit("high").alias("model_confidence"), F.lit(30.9).alias("prediction_typical_error_pct"))
    nothing = F.lit(None).cast("string")
    attribution = F.struct(F.col("result.dominant_source").alias("dominant_source"), nothing.alias("source_confidence"),
                           nothing.alias("recommended_action"), F.col("result.urgency").alias("urgency"), nothing.alias("uncertainty_statement"))
    ready = (rows.withColumn("signals", signals).withColumn("attribution", attribution)
             .select("doc_id", "status", F.col("signals.date").alias("date"), F.col("doc_id").alias("cell"), replies.alert_facts().alias("facts")))
    sent = replies.dispatch(ready)
    return sent.join(ready.select("cell", "doc_id", "facts"), "cell").select(
        "doc_id", "urgency", F.col("facts.likely_source").alias("likely_source"), "would_send",
        F.array_join("authority_recipients", ";").alias("recipients"), F.col("facts.predicted_pm25_ug_m3").alias("predicted"))


@register("urgency_violations", """SELECT event_id, value FROM events WHERE event_type = 'view' AND (value <= 120 OR user_id % 5 = 0)""")
def urgency_violations(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id", "value", pm25_label("value").alias("predicted_category"),
        F.when(F.col("user_id") % 5 == 0, "low").otherwise("high").alias("model_confidence"),
        F.when(F.col("event_type") == "view", "urgent").otherwise("elevated").alias("urgency"))
    return replies.urgency_violations(rows).select("event_id", "value")


# ---------------------------------------------------------------- chosen cells and their signals

from skyhive.registry.validation import levels, predicted_days  # noqa: E402

CENTRES = {"north_centre": (28.0, 78.0), "south_centre": (12.0, 74.0)}
_PICK = """SELECT p.date, {n} AS ord, '{role}' AS role, arg_min(p.cell, (-pm25, p.cell)) AS cell FROM predicted p WHERE {test} AND NOT EXISTS (
 SELECT 1 FROM picks{before} q JOIN full_grid h ON h.cell = q.cell WHERE q.date = p.date AND {km} < 300) GROUP BY p.date"""
_KM = haversine("p.lat", "p.lon", "h.lat", "h.lon")
fragment("picks1", "SELECT date, ord, role, p.cell FROM predicted p JOIN (VALUES " + ", ".join(
    f"({i}, '{r}', {cell_of(f'CAST({la} AS DOUBLE)', f'CAST({lo} AS DOUBLE)', RES)})" for i, (r, (la, lo)) in enumerate(CENTRES.items()))
    + ") c(ord, role, cell) ON c.cell = p.cell", "predicted")
for _n, _role, _test in ((2, "dark_zone", "dist_working_km > 50 AND dist_nearest_km > 50"), (3, "dark_zone", "dist_working_km > 50 AND dist_nearest_km > 50"),
                         (4, "low_confidence", "confidence = 2")):
    fragment(f"picks{_n}", f"SELECT * FROM picks{_n - 1} UNION ALL " + _PICK.format(n=_n, role=_role, test=_test, before=_n - 1, km=_KM),
             f"picks{_n - 1}", "predicted", "full_grid")


@register("chosen_cells", query("SELECT date, CAST(ord AS INTEGER) AS ord, role, cell FROM picks4", "picks4"))
def chosen_cells(spark, sf):
    rows = cut_lineage(predicted_days(spark, sf), "predicted")
    return packs.select_cells(rows, RES, CENTRES).select("date", "ord", "role", "cell")


@register("signal_packs", query(f"""SELECT p.date, p.ord, p.role, p.cell, printf('%.1f', round_even(pm25, 1)) AS pm25, {sql_label('s.pm25')} AS category,
 ['high', 'medium', 'low'][confidence + 1] AS confidence, n_reporting > 0 AS anchored,
 (SELECT string_agg(health || '=' || n, ',' ORDER BY health) FROM (SELECT health, count(*) AS n FROM sites t WHERE
 {fixed6(haversine('s.lat', 's.lon', 't.lat', 't.lon'))} <= 50 GROUP BY health) z) AS within_50km
 FROM (SELECT date, CAST(ord AS INTEGER) AS ord, role, cell FROM picks4) p JOIN predicted s USING (date, cell)""", "picks4", "predicted", "sites"))
def signal_packs(spark, sf):
    rows = cut_lineage(predicted_days(spark, sf, with_features=True), "predicted")
    chosen = cut_lineage(packs.select_cells(rows, RES, CENTRES), "picks")
    grid_about = rows.select("cell").distinct().withColumn("district", F.lit(None).cast("string")).withColumn("state", F.lit("any"))
    out = packs.signal_packs(rows, chosen, grid_about, sites(spark, sf), levels(spark, sf))
    near = F.array_join(F.transform(F.array_sort(F.map_entries("signals.monitors_within_50km_by_health")),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("date", "ord", "role", "cell", F.format_string("%.1f", F.col("signals.predicted_pm25_ug_m3")).alias("pm25"),
                      F.col("signals.predicted_category").alias("category"), F.col("signals.model_confidence").alias("confidence"),
                      F.col("signals.distance_to_nearest_reporting_monitor_km").isNotNull().alias("anchored"),
                      F.when(near != "", near).alias("within_50km"))


@register("percentile_ranks", query("""SELECT o.o_orderkey, CAST(round_even(100.0 * (SELECT count(*) FROM orders x WHERE x.o_orderpriority = o.o_orderpriority
 AND x.o_totalprice < o.o_totalprice) / (SELECT count(o_totalprice) FROM orders x WHERE x.o_orderpriority = o.o_orderpriority), 0) AS INTEGER) AS percentile
 FROM orders o WHERE o.o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_orderpriority)"""))
def percentile_ranks(spark, sf):
    """The rank of one chosen order of each priority among all of them; priorities play the part of days."""
    rows = spark.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderpriority").alias("date"), F.col("o_orderkey").alias("cell"), F.col("o_totalprice").alias("price"))
    chosen = rows.groupBy("date").agg(F.max("cell").alias("cell"))
    out = packs.percentile_among(rows, chosen, ["price"])
    return out.select(F.col("cell").alias("o_orderkey"), F.col("price_percentile").alias("percentile"))


@register("explanation_lookup", query("""SELECT c.clicked, arg_min(e.cell, e.ord) AS explained FROM (SELECT DISTINCT cell_r4 AS clicked FROM full_grid) c
 LEFT JOIN (SELECT ord, cell, cell_r4 FROM (SELECT cell, cell_r4, row_number() OVER (ORDER BY cell) AS ord FROM full_grid WHERE station_count > 0) x) e
 ON e.cell_r4 = c.clicked GROUP BY c.clicked""", "full_grid"))
def explanation_lookup(spark, sf):
    from skyhive.registry.space import full_grid

    cells = full_grid(spark, sf)
    explained = cells.where("station_count > 0").select(F.col("cell").alias("ord"), "cell", F.col("cell").alias("cell_r5"), "cell_r4", F.lit("dark_zone").alias("role"))
    clicked = cells.select(F.col("cell_r4").alias("clicked")).distinct()
    return rollup.explanation_at(explained, clicked).select("clicked", "explained")


# ---------------------------------------------------------------- tables written and read back

@register("replaced_partitions", query("""SELECT state, parameter, count(*) AS rows, round(sum(value), 4) AS total FROM (SELECT state, parameter,
 CASE WHEN parameter = 'pm25' THEN value * 2 ELSE value END AS value FROM readings_multi) r GROUP BY ALL""", "readings_multi"))
def replaced_partitions(spark, sf):
    """A table whose PM2.5 partitions were replaced; all others must have stayed."""
    from skyhive.sinks.tables import replace_partitions

    rows = load(spark, sf, "readings_multi").withColumn("month", F.date_format("timestamp_utc", "yyyy-MM"))
    path = shared_path(spark, "history")
    replace_partitions(rows, path)
    replace_partitions(rows.where("parameter = 'pm25'").withColumn("value", F.col("value") * 2), path)
    return (spark.read.parquet(path).groupBy("state", "parameter")
            .agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("total")))


@register("refiltered_table", query("""SELECT state, parameter, count(*) AS rows FROM (SELECT * REPLACE (value * 10 AS value) FROM readings_multi) r
 LEFT JOIN caps USING (parameter, unit) WHERE NOT (value > coalesce(ceiling, 1e300))
 AND value NOT IN (999.0, 999.9, 999.99, 9999.0, 99999.0) GROUP BY ALL""", "readings_multi", "caps"))
def refiltered_table(spark, sf):
    from skyhive.sinks.tables import refilter_history, replace_partitions

    rows = (load(spark, sf, "readings_multi").withColumn("value", F.col("value") * 10)
            .withColumn("month", F.date_format("timestamp_utc", "yyyy-MM")))
    path = shared_path(spark, "history")
    replace_partitions(rows, path)
    refilter_history(spark, path)
    return spark.read.parquet(path).groupBy("state", "parameter").agg(F.count(F.lit(1)).alias("rows"))


@register("refreshed_flags", query("""SELECT parameter, quality_flag, count(*) AS rows FROM flat_flagged GROUP BY ALL""", "flat_flagged"))
def refreshed_flags(spark, sf):
    """Flags written into a stored table, twice; the second run must change nothing."""
    from skyhive.sinks.tables import refresh_flags, replace_partitions

    rows = load(spark, sf, "flat").withColumn("month", F.date_format("timestamp_utc", "yyyy-MM"))
    path = shared_path(spark, "history")
    replace_partitions(rows, path)
    refresh_flags(spark, path, ["line"], span_seconds=3600)
    refresh_flags(spark, path, ["line"], span_seconds=3600)
    return spark.read.parquet(path).groupBy("parameter", "quality_flag").agg(F.count(F.lit(1)).alias("rows"))


@register("run_summary", query("""SELECT (SELECT count(*) FROM marked) AS raw_rows, (SELECT count(*) FROM cleaned) AS kept_rows, (SELECT count(*) FROM marked WHERE fate = 'negative') AS negative,
 (SELECT count(*) FROM cleaned WHERE parameter = 'pm10') AS pm10_rows, (SELECT count(DISTINCT state) FROM cleaned) AS states""", "marked", "cleaned"))
def run_summary(spark, sf):
    """The JSON summary of a run, read back."""
    from skyhive.sinks.tables import run_summary as summary

    judged = clean.judge(clean.normalise(raw(spark, sf)))
    counts = cut_lineage(clean.drop_counts(judged, ["line"]), "counts")
    kept = cut_lineage(clean.clean(raw(spark, sf)).withColumn("city", F.lit(None).cast("string")), "clean")
    text = summary(counts, cut_lineage(ST.corpus_counts(kept), "corpus"), ST.value_profile(kept))
    back = F.from_json("summary", "raw_rows bigint, kept_rows bigint, dropped_by_reason map<string,bigint>, rows_per_parameter map<string,bigint>, states_covered bigint")
    return text.withColumn("s", back).select("s.raw_rows", "s.kept_rows", F.col("s.dropped_by_reason")["negative"].alias("negative"),
                                             F.col("s.rows_per_parameter")["pm10"].alias("pm10_rows"), F.col("s.states_covered").alias("states"))
