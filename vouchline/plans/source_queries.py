"""Source and sink queries on synthetic log lines, uploads and result documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from vouchline.operators import records
from vouchline.sources import files

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "user_id")


@query("trace_log", "SELECT event_id, '12:34:56.789' AS ts, 'INFO' AS level, 'run_' || event_type AS func, CASE WHEN event_id % 2 = 0 THEN 'fn' || user_id::VARCHAR ELSE '' END AS fn, 'call ' || event_id::VARCHAR AS msg FROM events WHERE event_id % 5 <> 0")
def trace_log(spark, sf):
    line = F.expr("concat('12:34:56.789 | INFO | run_', event_type, ' | ', IF(event_id % 2 = 0, concat('[fn', CAST(user_id AS string), '] '), ''), 'call ', CAST(event_id AS string))")
    noise = F.when(F.col("event_id") % 5 == 0, "not a trace line").otherwise(line)
    return files.parse_trace(_events(spark, sf).select("event_id", noise.alias("value")))


@query("trace_calls", "SELECT 'run_' || event_type AS func, count(*)::BIGINT AS calls FROM events WHERE event_id % 5 <> 0 GROUP BY event_type")
def trace_calls(spark, sf):
    return trace_log(spark, sf).groupBy("func").agg(F.count(F.lit(1)).alias("calls"))


@query("upload_source", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 3 THEN NULL ELSE event_type || '!' END AS body FROM events")
def upload_source(spark, sf):
    e = _events(spark, sf)
    packed = F.base64(F.encode(F.concat("event_type", F.lit("!")), "UTF-8"))
    k = F.col("event_id") % 4
    part = F.when(k == 0, F.encode("event_type", "UTF-8"))
    form = F.when(k == 1, F.concat(F.lit("data:image/png;base64,"), packed)).when(k == 3, F.lit("%%%"))
    body = F.when(k == 2, packed)
    return e.select("event_id", F.decode(files.upload_bytes(part, form, body), "UTF-8").alias("body"))


@query("result_json", """SELECT event_id, '{"stage":"' || event_type || '","gate":' || CASE WHEN user_id % 3 = 0 THEN 'null' ELSE (user_id % 3)::VARCHAR END || '}' AS doc FROM events""")
def result_json(spark, sf):
    gate = F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 3)
    return _events(spark, sf).select("event_id", files.to_result_json(F.struct(F.col("event_type").alias("stage"), gate.alias("gate"))).alias("doc"))


@query("missing_input", "SELECT event_id, CASE WHEN event_id % 3 = 0 OR user_id % 7 = 0 THEN 'error' END AS stage, CASE WHEN event_id % 3 = 0 OR user_id % 7 = 0 THEN 0 END AS gate FROM events")
def missing_input(spark, sf):
    e = _events(spark, sf).withColumn("front", F.when(F.col("event_id") % 3 != 0, "f")).withColumn("selfie", F.when(F.col("user_id") % 7 != 0, "s"))
    return e.select("event_id", records.missing_input(F.col("front"), F.col("selfie")).alias("m")).select("event_id", "m.*")
