"""Queries over events, orders and line items: features, payloads, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.functions import scalars
from vicinal.operators import evaluate, features, index, scoring, windows
from vicinal.plans.vector_queries import empty_index
from vicinal.session import new_path, spread, table, written
from vicinal.sources import metrics_text, payloads
from vicinal.streaming import score

#: Risks by event type for the lookup query, each that of a merchant category; other types take the default.
EVENT_RISK = {"purchase": features.MCC_RISK["7801"], "click": features.MCC_RISK["5411"], "error": features.MCC_RISK["7802"]}
#: Orders of these priorities stand for fraud where payloads are scored.
FRAUD_PRIORITIES = ("1-URGENT", "2-HIGH")
KNOWN_TYPES = ("view", "click", "purchase")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))


def clamp01_normalize(spark, sf_dir):
    f = lambda c, by: F.round(scalars.scaled(F.col(c), by).cast("double"), 6)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", f("l_extendedprice", 10_000).alias("amount"), f("l_quantity", 12).alias("installments"))


def ratio_zero_guard(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    means = orders.groupBy("o_custkey").agg((F.sum("cents") / F.count(F.lit(1)) / 100).alias("mean"))
    ratio = scalars.ratio_or_zero(F.col("o_totalprice"), F.when(F.col("o_custkey") % 10 == 0, 0.0).otherwise(F.col("mean")))
    return orders.join(means, "o_custkey").select("o_orderkey", F.round(ratio, 6).alias("amount_vs_avg"))


def hour_weekday_features(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    f = lambda x, by: F.round(scalars.scaled(x, by).cast("double"), 6)
    return table(spark, sf_dir, "events").select("event_id", f(F.hour(ts), 23).alias("hour_of_day"), f(F.weekday(ts), 6).alias("day_of_week"))


def minutes_since_last_event(spark, sf_dir):
    found = windows.since_last(_events(spark, sf_dir), ["user_id"], "sec", "event_id")
    minutes = F.floor((F.col("sec") - F.col("last_sec")) / 60)
    value = F.when(F.col("last_sec").isNull(), F.lit(-1.0)).otherwise(scalars.scaled(minutes, 1440).cast("double"))
    return found.select("event_id", F.round(value, 6).alias("minutes_since_last"))


def tx_count_24h(spark, sf_dir):
    found = windows.count_within(_events(spark, sf_dir).select("event_id", "user_id", "sec"), ["user_id"], "sec", 86_400, "count_24h")
    return found.select("event_id", (F.col("count_24h") - 1).alias("count_24h"))


def risk_lookup_default(spark, sf_dir):
    risks = F.broadcast(spark.createDataFrame(sorted(EVENT_RISK.items()), "event_type string, risk double"))
    joined = _events(spark, sf_dir).join(risks, "event_type", "left")
    return joined.select("event_id", F.coalesce("risk", F.lit(features.UNKNOWN_RISK)).alias("risk"))


def unknown_member_flag(spark, sf_dir):
    known = F.array(*map(F.lit, KNOWN_TYPES))
    return _events(spark, sf_dir).select("event_id", (~F.array_contains(known, F.col("event_type"))).cast("int").alias("unknown"))


def json_payload_extract(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


def payload_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and a request payload made from each order and its customer, some of them defective."""
    o = spread(table(spark, sf_dir, "orders")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    at = F.col("o_orderdate").cast("timestamp")
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    merchant = F.concat(F.lit("M"), (cust % 20).cast("string"))
    mcc = F.element_at(F.array(*map(F.lit, ["5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311", "5999", "1234", "12a4"])), (key % 12 + 1).cast("int"))
    since = stamp(F.timestamp_seconds(F.unix_seconds(at) - (cust % 3000) * 61))
    last = F.struct(F.when(key % 73 == 0, "yesterday").otherwise(since).alias("timestamp"), (cust % 1300).cast("double").alias("km_from_current"))
    asked = stamp(at)
    asked = F.when(key % 158 == 0, F.concat(F.substring(asked, 1, 11), F.lit("24"), F.substring(asked, 14, 7))).when(key % 79 == 0, F.concat(F.substring(asked, 1, 5), F.lit("13"), F.substring(asked, 8, 13))).otherwise(asked)
    request = F.struct(
        key.cast("string").alias("id"),
        F.struct((F.col("o_totalprice") / 10).alias("amount"), (key % 15 - F.when(key % 97 == 0, 100).otherwise(0)).alias("installments"), asked.alias("requested_at")).alias("transaction"),
        F.struct(F.when(cust % 11 == 0, 0.0).otherwise(F.abs("c_acctbal")).alias("avg_amount"), (cust % 25).alias("tx_count_24h"), F.array(F.lit("M1"), F.concat(F.lit("M"), (key % 20).cast("string"))).alias("known_merchants")).alias("customer"),
        F.struct(merchant.alias("id"), mcc.alias("mcc"), F.abs(F.col("c_acctbal") * 2).alias("avg_amount")).alias("merchant"),
        F.struct((key % 2 == 0).alias("is_online"), (key % 3 == 0).alias("card_present"), F.when(key % 83 != 0, F.col("o_totalprice") / 300).alias("km_from_home")).alias("terminal"),
        F.when(key % 5 != 0, last).alias("last_transaction"),
    )
    text = F.to_json(request)
    return o.select("o_orderkey", F.when(key % 89 == 0, F.substring(text, 1, 40)).otherwise(text).alias("value"), F.col("o_orderpriority").isin(*FRAUD_PRIORITIES).alias("is_fraud"))


def payload_validation(spark, sf_dir):
    rows = features.parse(payload_rows(spark, sf_dir)).select("o_orderkey", features.rejection().alias("reason"))
    return rows.select("o_orderkey", F.coalesce("reason", F.lit("valid")).alias("reason"))


def payload_vectorize_14(spark, sf_dir):
    rows = features.vectorize(payload_rows(spark, sf_dir)).filter("reason is null")
    return rows.select("o_orderkey", *(F.round(F.col("features")[i].cast("double"), 5).alias(name) for i, name in enumerate(features.FEATURES)))


def payload_strict_validation(spark, sf_dir):
    """Rejections in strict mode, of payloads some of which have a member of their own or a number with an exponent."""
    rows = payload_rows(spark, sf_dir)
    key, value = F.col("o_orderkey"), F.col("value")
    # A null member, which is left out of the texts, stands in these but for some.
    value = F.when((key % 5 == 0) & (key % 85 != 0) & (key % 89 != 0), F.regexp_replace(value, r"\}$", ',"last_transaction":null}')).otherwise(value)
    odd = F.when(key % 71 == 0, F.regexp_replace(value, r"\}$", ',"more":1}')).when(key % 67 == 0, F.regexp_replace(value, '"installments":', '"installments":1e')).when(key % 61 == 0, F.concat(value, F.lit(" trailing")))
    rows = features.vectorize(rows.select("o_orderkey", F.coalesce(odd, value).alias("value")), strict=True)
    return rows.select("o_orderkey", F.coalesce("reason", F.lit("valid")).alias("reason"))


#: What the literals query puts into a valid payload, by its key modulo their number: (pattern, replacement).
LITERALS = (
    ('"is_online":(true|false)', '"is_online":True'), ('"is_online":(true|false)', '"is_online":1'), ('"amount":[-0-9.Ee]+', '"amount":-5.5'),
    (r'"mcc":"[0-9]', r'"mcc":"\\u0034'), ('"km_from_home":[-0-9.Ee]+', '"km_from_home":+1.5'), ('"km_from_home":[-0-9.Ee]+', '"km_from_home":2.5e2'),
    ('"tx_count_24h":[0-9]+', '"tx_count_24h":4294967295'), ('"tx_count_24h":[0-9]+', '"tx_count_24h":4294967296'), ('"km_from_home":[-0-9.Ee]+', '"km_from_home":-7'),
)


def payload_literals(spark, sf_dir):
    """Reasons and features of valid payloads with another literal in them: booleans, signs, exponents, escapes, the ends of ranges."""
    rows = features.vectorize(payload_rows(spark, sf_dir)).filter("reason is null").select("o_orderkey", "value")
    kind, value = F.col("o_orderkey") % len(LITERALS), F.col("value")
    for i, (pattern, literal) in enumerate(LITERALS):
        value = F.when(kind == i, F.regexp_replace("value", pattern, literal)).otherwise(value)
    found = features.vectorize(rows.select("o_orderkey", value.alias("value")))
    at = lambda name: F.round(F.col("features")[features.FEATURES.index(name)].cast("double"), 5).alias(name)
    return found.select("o_orderkey", F.coalesce("reason", F.lit("valid")).alias("reason"), *map(at, ("amount", "km_from_home", "tx_count_24h", "mcc_risk")))


def payload_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index of all valid payloads but the requests, by splits: their features, labelled by their orders' priority."""
    rows = features.quantized(payload_rows(spark, sf_dir).filter("o_orderkey % 100 <> 0")).filter("reason is null")
    refs = written(rows.select(F.col("o_orderkey").alias("ref_id"), "v", "is_fraud"), "references")
    if refs.isEmpty():
        return empty_index(refs)
    path = new_path(spark, "index")
    return index.load(spark, path, index.save_split(refs, path))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads to score: those whose order's key is divisible by 100."""
    return payload_rows(spark, sf_dir).filter("o_orderkey % 100 = 0").withColumnRenamed("o_orderkey", "q_id")


def payload_score(spark, sf_dir):
    return scoring.score_payloads(requests(spark, sf_dir), payload_index(spark, sf_dir))


def payload_score_stream(spark, sf_dir):
    """The answers of ``payload_score``, by a stream of payload texts."""
    asked = new_path(spark, "payloads")
    rows = requests(spark, sf_dir).select("q_id", "value")
    rows.write.parquet(asked)
    path = new_path(spark, "answers")
    stream = spark.readStream.schema(rows.schema).parquet(asked)
    score.score_stream(stream, scoring.payload_scorer(payload_index(spark, sf_dir)), path, new_path(spark, "stream")).awaitTermination()
    return spark.read.parquet(path).drop("batch")


def corpus_evaluation(spark, sf_dir):
    """Accuracy over a test corpus that is written, read back and scored; an order's own label is what is expected."""
    path = new_path(spark, "corpus")
    payloads.write_corpus(requests(spark, sf_dir).select("value", (~F.col("is_fraud")).alias("expected_approved"), F.lit(0.0).alias("expected_fraud_score")), path)
    entries = payloads.read_corpus(spark, path, lines=True).withColumn("q_id", F.xxhash64("value"))
    return scoring.evaluate_corpus(entries, payload_index(spark, sf_dir)).withColumn("accuracy", F.round("accuracy", 6))


def payload_array_files(spark, sf_dir):
    """What is read back from the events' properties as files of one JSON array each."""
    arrays = _events(spark, sf_dir).groupBy((F.col("event_id") % 7).alias("part")).agg(F.array_sort(F.collect_list(F.struct("event_id", "props"))).alias("a"))
    path = new_path(spark, "arrays")
    arrays.select("part", F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["props"]), ","), F.lit("]")).alias("value")).write.partitionBy("part").text(path)
    part = F.regexp_extract("file", "part=([0-9]+)/", 1).cast("bigint")
    return payloads.read_payload_array(spark, path).select(part.alias("part"), "pos", F.get_json_object("value", "$.k").cast("bigint").alias("k"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_type", F.floor(F.abs("value") * 100).cast("bigint").alias("v"))


def log2_histogram(spark, sf_dir):
    return evaluate.log2_histogram(_values(spark, sf_dir), ["event_type"], scalars.log2_bucket(F.col("v")))


def histogram_quantile(spark, sf_dir):
    return evaluate.histogram_quantile(log2_histogram(spark, sf_dir), ["event_type"], {"p50": 0.5, "p90": 0.9, "p99": 0.99})


def percentile_nearest_rank(spark, sf_dir):
    return evaluate.nearest_rank(_values(spark, sf_dir), ["event_type"], "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


def sketch_quantiles(spark, sf_dir):
    """Quantiles of each event type from sketches of its days, merged; within: the rank is no further off than the sketch's bound."""
    rows = _events(spark, sf_dir).select("event_type", F.floor(F.col("sec") / 86_400).alias("day"), F.floor(F.abs("value") * 100).cast("bigint").alias("v"))
    days = written(evaluate.sketches(rows, ["event_type", "day"], "v"), "sketches")
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    found = evaluate.sketch_quantiles(evaluate.merged_sketches(days, ["event_type"]), ["event_type"], shares)
    each = found.select("event_type", "n", F.explode(F.map_from_arrays(F.array(*map(F.lit, shares.values())), F.array(*shares))).alias("share", "x"))
    counts = rows.groupBy("event_type", "v").agg(F.count(F.lit(1)).alias("m"))
    ranks = each.join(counts, "event_type").groupBy("event_type", "n", "share", "x").agg(F.sum(F.when(F.col("v") < F.col("x"), F.col("m")).otherwise(0)).alias("less"), F.sum(F.when(F.col("v") <= F.col("x"), F.col("m")).otherwise(0)).alias("upto"))
    room, want = F.lit(evaluate.SKETCH_ERROR) * F.col("n") + 1, F.col("share") * F.col("n")
    return ranks.select("event_type", "n", "share", ((F.col("less") <= want + room) & (F.col("upto") >= want - room)).alias("within"))


def latency_summary(spark, sf_dir):
    s = evaluate.summary(_values(spark, sf_dir), ["event_type"], "v")
    return s.select("event_type", "n", "least", "most", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"))


def snapshot_deltas(spark, sf_dir):
    hours = _events(spark, sf_dir).groupBy("event_type", F.floor(F.col("sec") / 3600).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    upto = hours.select("event_type", "hour", F.sum("n").over(Window.partitionBy("event_type").orderBy("hour")).alias("events"))
    return evaluate.deltas(upto, ["event_type"], "hour", ["events"])


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """instance, sec (the end of each day), requests, errors, clicks: counters that only rise."""
    e = _events(spark, sf_dir).withColumn("instance", F.pmod("user_id", F.lit(4)))
    days = e.groupBy("instance", ((F.floor(F.col("sec") / 86_400) + 1) * 86_400).alias("sec"))
    days = days.agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    upto = Window.partitionBy("instance").orderBy("sec")
    return days.select("instance", "sec", *(F.sum(c).over(upto).alias(c) for c in ("requests", "errors", "clicks")))


def snapshot_rates(spark, sf_dir):
    found = evaluate.rates(_snapshots(spark, sf_dir), ["instance"], "sec", "requests", ["errors", "clicks"])
    return found.select("instance", "sec", "requests_delta", "errors_delta", "clicks_delta", *(F.round(c, 8).alias(c) for c in ("per_second", "errors_per_requests", "clicks_per_requests")))


def _bucket_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, day, bucket, n: cumulative log2 histograms, in which a bucket stays once it has a count."""
    v = _events(spark, sf_dir).select("event_type", F.floor(F.col("sec") / 86_400).alias("day"), F.floor(F.abs("value") * 100).cast("bigint").alias("v"))
    new = evaluate.log2_histogram(v, ["event_type", "day"], scalars.log2_bucket(F.col("v")))
    upto = F.sum("n").over(Window.partitionBy("event_type", "bucket").orderBy("day"))
    return new.select("event_type", "day", "bucket", upto.alias("n"))


def window_quantiles(spark, sf_dir):
    windows = evaluate.window_histogram(_bucket_snapshots(spark, sf_dir), ["event_type"], "day")
    return evaluate.histogram_quantile(windows, ["event_type", "day"], {"p50": 0.5, "p90": 0.9, "p99": 0.99})


def metrics_summary(spark, sf_dir):
    return metrics_text.summary_lines(evaluate.bucket_summary(_values(spark, sf_dir), F.col("event_type"), F.col("v"), scalars.log2_bucket(F.col("v"))))


def metrics_timeline(spark, sf_dir):
    """What is read back from a timeline of snapshots with the buckets of all event types, in two appends."""
    b = _bucket_snapshots(spark, sf_dir).groupBy("event_type", "day").agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("string"), "n"))).alias("m"))
    b = b.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "m"))).alias("b"))
    rows = _snapshots(spark, sf_dir).join(b, F.floor(F.col("sec") / 86_400) - 1 == F.col("day"), "left").select(
        F.concat(F.lit("instance-"), "instance").alias("label"), F.col("sec").alias("sample"), F.lit(86_400.0).alias("dt_s"),
        F.create_map(F.lit("requests"), "requests", F.lit("errors"), "errors").alias("counters"), F.col("b").alias("buckets"),
    )
    path = new_path(spark, "timeline")
    for odd in (0, 1):
        metrics_text.write_timeline(rows.filter(F.substring("label", -1, 1).cast("int") % 2 == odd), path)
    back = metrics_text.read_timeline(spark, path)
    entries = back.select("label", "sample", F.col("counters")["requests"].alias("requests"), F.col("counters")["errors"].alias("errors"), F.explode_outer("buckets").alias("event_type", "m"))
    return entries.select("label", "sample", "requests", "errors", "event_type", F.explode_outer("m").alias("bucket", "n"))


def run_stats(spark, sf_dir):
    runs = _events(spark, sf_dir).select("event_type", "event_id", (F.floor(F.abs("value") * 1000).cast("bigint") + 1_000_000).alias("ns"), F.lit(50_000_000).cast("bigint").alias("bytes"), F.lit(3_000_000).cast("bigint").alias("records"))
    found = evaluate.run_stats(runs, "event_type", "event_id")
    return found.select("event_type", "runs", "cold_ns", "min_ns", "median_ns", F.round("mib_per_s", 4).alias("mib_per_s"), F.round("records_per_s", 2).alias("records_per_s"))


def record_count(spark, sf_dir):
    from vicinal.sources.references import count_records

    return count_records(table(spark, sf_dir, "events"), "props")


def payload_slices(spark, sf_dir):
    from vicinal.sources.payloads import slices

    arrays = _events(spark, sf_dir).groupBy("user_id", F.floor(F.col("event_id") / 100).alias("part")).agg(F.array_sort(F.collect_list(F.struct("event_id", "props"))).alias("a"))
    texts = arrays.select("user_id", "part", F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["props"]), ","), F.lit("]")).alias("value"))
    return slices(texts).select("user_id", "part", "pos", F.get_json_object("payload", "$.k").cast("bigint").alias("k"))


def metrics_text_round_trip(spark, sf_dir):
    rows = _values(spark, sf_dir)
    counters = rows.groupBy(F.concat(F.lit("events_"), "event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    buckets = evaluate.log2_histogram(rows.withColumnRenamed("event_type", "name"), ["name"], scalars.log2_bucket(F.col("v")))
    lines = metrics_text.report(counters).union(metrics_text.bucket_lines(buckets))
    return metrics_text.parse(lines)


QUERIES = {
    f.__name__: f
    for f in (
        clamp01_normalize, ratio_zero_guard, hour_weekday_features, minutes_since_last_event, tx_count_24h, risk_lookup_default, unknown_member_flag,
        json_payload_extract, payload_validation, payload_strict_validation, payload_literals, payload_vectorize_14, payload_score, payload_score_stream, corpus_evaluation, payload_array_files, log2_histogram, histogram_quantile, percentile_nearest_rank, sketch_quantiles, latency_summary,
        snapshot_deltas, snapshot_rates, window_quantiles, metrics_summary, metrics_timeline, run_stats, record_count, payload_slices, metrics_text_round_trip,
    )
}


def _scaled(x: str, by: float) -> str:
    return f"least(CAST(1 AS FLOAT), greatest(CAST(0 AS FLOAT), CAST(CAST({x} AS FLOAT) / CAST({by} AS DOUBLE) AS FLOAT)))"


def _f(x: str, by: float, places: int = 6) -> str:
    return f"round(CAST({_scaled(x, by)} AS DOUBLE), {places})"


_SEC = "epoch_us(ts) // 1000000"
_V = "v AS (SELECT event_type, CAST(floor(abs(value) * 100) AS BIGINT) AS v FROM events)"
_H = f"{_V}, h AS (SELECT event_type, CASE WHEN v = 0 THEN 0 ELSE length(bin(v)) END AS bucket, count(*) AS n FROM v GROUP BY ALL)"
_O = f"""o AS (
    SELECT *, abs(c_acctbal) AS bal, ['5411', '5812', '5912', '5944', '7801', '7802', '7995', '4511', '5311', '5999', '1234', '12a4'][CAST(o_orderkey % 12 + 1 AS INTEGER)] AS mcc,
        o_orderpriority IN {FRAUD_PRIORITIES} AS is_fraud,
        CASE WHEN o_orderkey % 89 = 0 THEN 'malformed' WHEN o_orderkey % 83 = 0 THEN 'missing_field'
        WHEN o_orderkey % 15 - CASE WHEN o_orderkey % 97 = 0 THEN 100 ELSE 0 END < 0 THEN 'invalid_number' WHEN o_orderkey % 79 = 0 THEN 'invalid_date'
        WHEN o_orderkey % 12 = 11 THEN 'invalid_mcc' WHEN o_orderkey % 73 = 0 AND o_orderkey % 5 <> 0 THEN 'invalid_last_transaction' ELSE 'valid' END AS reason
    FROM orders JOIN customer ON o_custkey = c_custkey
)"""
_RISKS = "CASE mcc " + " ".join(f"WHEN '{mcc}' THEN {risk}" for mcc, risk in sorted(features.MCC_RISK.items())) + f" ELSE {features.UNKNOWN_RISK} END"
_AVG = "(CASE WHEN o_custkey % 11 = 0 THEN 0 ELSE bal END)"
#: The 14 features as 32-bit floats, in order.
_14 = (
    _scaled("(o_totalprice / 10)", 10000), _scaled("(o_orderkey % 15)", 12), _scaled(f"(CASE WHEN {_AVG} = 0 THEN 0 ELSE o_totalprice / 10 / {_AVG} END)", 10),
    _scaled("hour(o_orderdate)", 23), _scaled("(isodow(o_orderdate) - 1)", 6),
    f"CASE WHEN o_orderkey % 5 = 0 THEN CAST(-1 AS FLOAT) ELSE {_scaled('(o_custkey % 3000 * 61 // 60)', 1440)} END",
    f"CASE WHEN o_orderkey % 5 = 0 THEN CAST(-1 AS FLOAT) ELSE {_scaled('(o_custkey % 1300)', 1000)} END",
    _scaled("(o_totalprice / 300)", 1000), _scaled("(o_custkey % 25)", 20), "CAST(CAST(o_orderkey % 2 = 0 AS INTEGER) AS FLOAT)", "CAST(CAST(o_orderkey % 3 = 0 AS INTEGER) AS FLOAT)",
    "CAST(CAST(o_custkey % 20 <> 1 AND o_custkey % 20 <> o_orderkey % 20 AS INTEGER) AS FLOAT)", f"CAST({_RISKS} AS FLOAT)", _scaled("(bal * 2)", 10000),
)
_GAPS = " + ".join(f"CAST(q.v[{i}] - r.v[{i}] AS BIGINT) * (q.v[{i}] - r.v[{i}])" for i in range(1, 15))
#: By brute force: every valid request against every valid reference.
_ANSWERS = f"""{_O}, f AS (
    SELECT o_orderkey, reason, is_fraud, CASE WHEN reason = 'valid' THEN list_transform([{", ".join(_14)}], lambda x: CAST(round(x * CAST(10000 AS FLOAT)) AS INTEGER)) END AS v FROM o
), near AS (
    SELECT q.o_orderkey AS q_id, r.is_fraud FROM f q JOIN f r ON q.o_orderkey % 100 = 0 AND r.o_orderkey % 100 <> 0 AND q.reason = 'valid' AND r.reason = 'valid'
    QUALIFY row_number() OVER (PARTITION BY q.o_orderkey ORDER BY {_GAPS}, r.o_orderkey) <= 5
), w AS (
    SELECT q_id, CAST(sum(CAST(is_fraud AS INTEGER)) AS BIGINT) AS votes FROM near GROUP BY q_id
), answers AS (
    SELECT o_orderkey AS q_id, nullif(reason, 'valid') AS reason, votes, votes / 5.0::DOUBLE AS fraud_score, votes < 3 AS approved, is_fraud,
        CASE WHEN reason = 'valid' THEN '{{"approved":' || (votes < 3) || ',"fraud_score":' || votes / 5.0::DOUBLE || '}}' ELSE '{{"error":"' || reason || '"}}' END AS response
    FROM f LEFT JOIN w ON q_id = o_orderkey WHERE o_orderkey % 100 = 0
)"""

_SNAP = f"""s AS (
    SELECT instance, sec, CAST(sum(r) OVER w AS BIGINT) AS requests, CAST(sum(e) OVER w AS BIGINT) AS errors, CAST(sum(c) OVER w AS BIGINT) AS clicks FROM (
        SELECT user_id % 4 AS instance, (({_SEC}) // 86400 + 1) * 86400 AS sec, count(*) AS r, count(*) FILTER (event_type = 'error') AS e, count(*) FILTER (event_type = 'click') AS c
        FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY instance ORDER BY sec)
)"""


def _pow(share: float) -> str:
    """The end of the first bucket that reaches a share, of rows with bucket, upto and total."""
    bucket = f"min(bucket) FILTER (upto >= greatest(1, floor({share} * total)))"
    return f"CAST(CASE WHEN {bucket} = 0 THEN 0 ELSE 2 ** {bucket} END AS BIGINT)"


ORACLE_SQL = {
    "clamp01_normalize": f"SELECT l_orderkey, l_linenumber, {_f('l_extendedprice', 10000)} AS amount, {_f('l_quantity', 12)} AS installments FROM lineitem",
    "ratio_zero_guard": """WITH m AS (SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / count(*) / 100 AS mean FROM orders GROUP BY 1)
        SELECT o_orderkey, round(CASE WHEN o_custkey % 10 = 0 OR mean = 0 THEN 0 ELSE o_totalprice / mean END, 6) AS amount_vs_avg FROM orders JOIN m USING (o_custkey)""",
    "hour_weekday_features": f"SELECT event_id, {_f('hour(ts)', 23)} AS hour_of_day, {_f('(isodow(ts) - 1)', 6)} AS day_of_week FROM events",
    "minutes_since_last_event": f"""WITH e AS (SELECT event_id, user_id, {_SEC} AS sec FROM events), l AS (
        SELECT event_id, sec - lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS gap FROM e)
        SELECT event_id, CASE WHEN gap IS NULL THEN -1.0::DOUBLE ELSE {_f('(gap // 60)', 1440)} END AS minutes_since_last FROM l""",
    "tx_count_24h": f"""WITH e AS (SELECT event_id, user_id, {_SEC} AS sec FROM events)
        SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) - 1 AS count_24h FROM e""",
    "risk_lookup_default": "SELECT event_id, CAST(CASE event_type WHEN 'purchase' THEN 0.8 WHEN 'click' THEN 0.15 WHEN 'error' THEN 0.75 ELSE 0.5 END AS DOUBLE) AS risk FROM events",
    "unknown_member_flag": "SELECT event_id, CAST(event_type NOT IN ('view', 'click', 'purchase') AS INTEGER) AS unknown FROM events",
    "json_payload_extract": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "payload_validation": f"WITH {_O} SELECT o_orderkey, reason FROM o",
    "payload_strict_validation": f"""WITH {_O} SELECT o_orderkey, CASE WHEN reason IN ('malformed', 'missing_field') OR o_orderkey % 71 = 0 OR o_orderkey % 67 = 0 OR o_orderkey % 85 = 0
        OR o_orderkey % 15 - CASE WHEN o_orderkey % 97 = 0 THEN 100 ELSE 0 END < 0 THEN 'not_strict' ELSE reason END AS reason FROM o""",
    "payload_literals": f"""WITH {_O}, l AS (SELECT *, o_orderkey % {len(LITERALS)} AS kind FROM o WHERE reason = 'valid'), c AS (
        SELECT o_orderkey, CASE WHEN kind IN (0, 1, 4) THEN 'malformed' WHEN kind = 7 THEN 'invalid_number' ELSE 'valid' END AS reason,
            CASE WHEN kind = 2 THEN -5.5 ELSE o_totalprice / 10 END AS a, CASE WHEN kind = 5 THEN 250 WHEN kind = 8 THEN -7 ELSE o_totalprice / 300 END AS km,
            CASE WHEN kind = 6 THEN 4294967295 ELSE o_custkey % 25 END AS tx, CASE WHEN kind = 3 THEN '4' || substr(mcc, 2) ELSE mcc END AS mcc FROM l)
        SELECT o_orderkey, reason, """ + ", ".join(f"CASE WHEN reason = 'valid' THEN {x} END AS {name}" for x, name in ((_f("a", 10000, 5), "amount"), (_f("km", 1000, 5), "km_from_home"), (_f("tx", 20, 5), "tx_count_24h"), (f"round(CAST(CAST({_RISKS} AS FLOAT) AS DOUBLE), 5)", "mcc_risk"))) + " FROM c",
    "payload_vectorize_14": f"WITH {_O} SELECT o_orderkey, " + ", ".join(f"round(CAST({x} AS DOUBLE), 5) AS {name}" for x, name in zip(_14, features.FEATURES, strict=True)) + " FROM o WHERE reason = 'valid'",
    "payload_score": f"WITH {_ANSWERS} SELECT q_id, reason, votes, fraud_score, approved, response FROM answers",
    "payload_score_stream": f"WITH {_ANSWERS} SELECT q_id, reason, votes, fraud_score, approved, response FROM answers",
    "corpus_evaluation": f"""WITH {_ANSWERS} SELECT count(*) AS total, count(*) FILTER (NOT is_fraud AND approved) AS approved_right, count(*) FILTER (is_fraud AND NOT approved) AS denied_right,
        count(*) FILTER (is_fraud AND approved) AS approved_wrong, count(*) FILTER (NOT is_fraud AND NOT approved) AS denied_wrong, count(*) FILTER (approved IS NULL) AS errors,
        round(count(*) FILTER (approved = NOT is_fraud) / count(*), 6) AS accuracy FROM answers""",
    "payload_array_files": "SELECT event_id % 7 AS part, row_number() OVER (PARTITION BY event_id % 7 ORDER BY event_id) - 1 AS pos, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "log2_histogram": f"WITH {_H} SELECT event_type, CAST(bucket AS INTEGER) AS bucket, n FROM h",
    "histogram_quantile": f"""WITH {_H}, c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM h)
        SELECT event_type, """ + ", ".join(f"{_pow(p)} AS {name}" for name, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))) + " FROM c GROUP BY event_type",
    "percentile_nearest_rank": f"""WITH {_V}, l AS (SELECT event_type, list_sort(list(v)) AS s FROM v GROUP BY event_type)
        SELECT event_type, """ + ", ".join(f"s[CAST(round({p} * (len(s) - 1)) AS BIGINT) + 1] AS {name}" for name, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + " FROM l",
    "sketch_quantiles": "SELECT event_type, count(*) AS n, share, true AS within FROM events, (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE)) s(share) GROUP BY event_type, share",
    "latency_summary": f"WITH {_V} SELECT event_type, count(*) AS n, min(v) AS least, max(v) AS most, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS stddev FROM v GROUP BY event_type",
    "snapshot_deltas": f"""WITH h AS (SELECT event_type, ({_SEC}) // 3600 AS hour, count(*) AS n FROM events GROUP BY ALL)
        SELECT event_type, hour, CASE WHEN row_number() OVER w > 1 THEN n END AS events_delta FROM h WINDOW w AS (PARTITION BY event_type ORDER BY hour)""",
    "snapshot_rates": f"""WITH {_SNAP}, d AS (SELECT *, requests - lag(requests) OVER w AS rd, errors - lag(errors) OVER w AS ed, clicks - lag(clicks) OVER w AS cd, sec - lag(sec) OVER w AS dt
        FROM s WINDOW w AS (PARTITION BY instance ORDER BY sec))
        SELECT instance, sec, rd AS requests_delta, ed AS errors_delta, cd AS clicks_delta, round(rd / dt, 8) AS per_second, round(ed / rd, 8) AS errors_per_requests, round(cd / rd, 8) AS clicks_per_requests FROM d""",
    "window_quantiles": f"""WITH h AS (SELECT event_type, ({_SEC}) // 86400 AS day, CAST(floor(abs(value) * 100) AS BIGINT) AS v FROM events), n AS (
        SELECT event_type, day, CASE WHEN v = 0 THEN 0 ELSE length(bin(v)) END AS bucket, count(*) AS n FROM h GROUP BY ALL), c AS (
        SELECT *, sum(n) OVER (PARTITION BY event_type, day ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY event_type, day) AS total FROM n)
        SELECT event_type, day, """ + ", ".join(f"{_pow(p)} AS {name}" for name, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99))) + " FROM c GROUP BY event_type, day",
    "metrics_summary": f"""WITH {_H}, c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY event_type) AS total FROM h), q AS (
        SELECT event_type, """ + ", ".join(f"{_pow(p)} AS {name}" for name, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99), ("p999", 0.999))) + """ FROM c GROUP BY event_type), a AS (
        SELECT event_type, count(*) AS n, CAST(sum(v) // count(*) AS BIGINT) AS mean, max(v) AS most FROM v GROUP BY event_type)
        SELECT 'hist_' || event_type || '_ns count=' || n || ' mean=' || mean || ' p50=' || p50 || ' p90=' || p90 || ' p99=' || p99 || ' p999=' || p999 || ' max=' || most AS value FROM a JOIN q USING (event_type)""",
    "metrics_timeline": f"""WITH {_SNAP}, h AS (SELECT event_type, ({_SEC}) // 86400 AS day, CAST(floor(abs(value) * 100) AS BIGINT) AS v FROM events), b AS (
        SELECT event_type, day, bucket, CAST(sum(n) OVER (PARTITION BY event_type, bucket ORDER BY day) AS BIGINT) AS n FROM (
        SELECT event_type, day, CASE WHEN v = 0 THEN 0 ELSE length(bin(v)) END AS bucket, count(*) AS n FROM h GROUP BY ALL))
        SELECT 'instance-' || instance AS label, sec AS sample, requests, errors, event_type, CAST(bucket AS VARCHAR) AS bucket, n FROM s LEFT JOIN b ON b.day = s.sec // 86400 - 1""",
    "run_stats": """WITH r AS (SELECT event_type, CAST(floor(abs(value) * 1000) AS BIGINT) + 1000000 AS ns, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events), l AS (
        SELECT event_type, list_sort(list(ns) FILTER (i > 1)) AS s, max(ns) FILTER (i = 1) AS cold_ns FROM r GROUP BY event_type)
        SELECT event_type, len(s) AS runs, cold_ns, s[1] AS min_ns, s[len(s) // 2 + 1] AS median_ns, round(50000000 / 1048576 / (s[1] / 1e9), 4) AS mib_per_s, round(3000000 / (s[1] / 1e9), 2) AS records_per_s FROM l WHERE len(s) > 0""",
    "record_count": "SELECT CAST(sum(length(props) - length(replace(props, '}', ''))) AS BIGINT) AS n FROM events",
    "payload_slices": """SELECT user_id, event_id // 100 AS part, CAST(row_number() OVER (PARTITION BY user_id, event_id // 100 ORDER BY event_id) - 1 AS INTEGER) AS pos,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
    "metrics_text_round_trip": f"""WITH {_H} SELECT 'counter' AS kind, 'events_' || event_type AS name, CAST(NULL AS VARCHAR) AS field, count(*) AS n FROM v GROUP BY event_type
        UNION ALL SELECT 'bucket', event_type, CAST(bucket AS VARCHAR), n FROM h""",
}
