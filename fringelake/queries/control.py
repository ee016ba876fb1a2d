"""Queries over flags, schedules, groups, jobs, logs, settings and strings."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from ..functions import text
from ..functions.lineage import shared_folder
from ..operators import control, preprocess
from ..streaming import ordered
from ..streaming.jobs import merged
from . import bridge
from .bridge import query, rounded, table


@query(sql="SELECT i, i > 2 AND i < 12 AND (i - 2) % 3 = 0 AS flag FROM range(20) AS t(i)")
def flag_table(spark, d):
    return spark.range(20).select(F.col("id").alias("i"), control.flag(F.col("id"), after=2, every=3, before=12).alias("flag"))


@query(sql="SELECT name, bool_or(on_ OR (i > after_ AND i < before_ AND (i - after_) % every_ = 0)) AS ok FROM (VALUES ('never', false, 99, 1, 0), ('always', true, 0, 1, 99), ('late', false, 20, 1, 99), ('some', false, 3, 4, 99), ('short', false, 3, 4, 7), ('just', false, 3, 4, 8)) AS t(name, on_, after_, every_, before_), range(1, 21) AS r(i) GROUP BY name")
def flag_any_true(spark, d):
    flags = {"never": False, "always": True, "late": {"after": 20, "every": 1}, "some": {"after": 3, "every": 4}, "short": {"after": 3, "every": 4, "before": 7}, "just": {"after": 3, "every": 4, "before": 8}}
    return spark.createDataFrame([(k, control.any_true(v, 20)) for k, v in flags.items()], "name string, ok boolean")


@query(sql="SELECT i, CASE WHEN i >= 10 THEN 0.1 WHEN i >= 4 THEN 0.5 ELSE 1.0 END AS value FROM range(20) AS t(i)")
def schedule_piecewise(spark, d):
    steps = spark.createDataFrame([(0, 1.0), (4, 0.5), (10, 0.1)], "start long, value double")
    return control.piecewise(spark.range(20).withColumnRenamed("id", "i"), steps)


@query(sql="SELECT i, round(0.5 * exp(0 - i / 20.0), 9) AS value FROM range(20) AS t(i)")
def schedule_expression(spark, d):
    return rounded(control.expression(spark.range(20).withColumnRenamed("id", "i"), "0.5 * exp(0 - i / niter)", 20), 9)


@query("scan", sql="SELECT grp, count(*) AS n FROM (SELECT ntile(32) OVER (ORDER BY pos_id) AS grp FROM scan) GROUP BY grp")
def group_sizes(spark, d):
    return control.group_sizes(control.even_groups(bridge.scan(spark, d).select("pos_id"), 32))


@query("scan", sql="SELECT n, count(*) AS groups FROM (SELECT count(*) AS n FROM (SELECT ntile(32) OVER (ORDER BY pos_id) AS grp FROM scan) GROUP BY grp) GROUP BY n")
def hash_groups(spark, d):
    sizes = control.group_sizes(control.even_groups(bridge.scan(spark, d).select("pos_id"), 32, seed=7))
    return sizes.groupBy("n").agg(F.count(F.lit(1)).alias("groups"))


@query(sql="SELECT k AS group_id, k % 3 = 0 AS used FROM range(32) AS t(k)")
def error_group_mask(spark, d):
    return control.fraction_mask(spark.range(32).withColumnRenamed("id", "group_id"), 32, 0.3)


@query(sql="SELECT CAST(thick AS DOUBLE) AS thick FROM (SELECT DISTINCT round(t, 5) AS thick FROM (VALUES (4.0), (4.000001), (2.5)) AS v(t))")
def distinct_thickness(spark, d):
    return spark.createDataFrame([(4.0,), (4.000001,), (2.5,)], "t double").select(F.round("t", 5).alias("thick")).distinct()


@query(sql="SELECT event_type AS var, count(DISTINCT user_id) AS solvers FROM events GROUP BY 1 HAVING count(DISTINCT user_id) > 1")
def duplicate_vars(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("var"), F.col("user_id").alias("solver"))
    return control.duplicates(e, "var", "solver").withColumnRenamed("n", "solvers")


@query(sql="SELECT list_sort(['object', 'probe', 'scan', 'tilt']) AS both, ['probe'] AS shared, ['object'] AS left_only, false AS inside")
def var_set_ops(spark, d):
    a, b = (F.array(*[F.lit(x) for x in xs]) for xs in (("object", "probe"), ("probe", "scan", "tilt")))
    return spark.range(1).select(F.sort_array(F.array_union(a, b)).alias("both"), F.array_intersect(a, b).alias("shared"), F.array_except(a, b).alias("left_only"), (F.size(F.array_except(a, b)) == 0).alias("inside"))


@query(sql="SELECT DISTINCT lang, list_sort(list_distinct(list_transform(string_split(lang || ', probe ,object,' || lang, ','), lambda x: trim(x)))) AS vars FROM documents")
def parse_var_set(spark, d):
    s = F.concat(F.col("lang"), F.lit(", probe ,object,"), F.col("lang"))
    return table(spark, d, "documents").select("lang").distinct().select("lang", F.sort_array(text.parse_set(s)).alias("vars"))


@query(sql="SELECT event_id, round(value, 4) AS error FROM events UNION ALL SELECT -1 AS event_id, 0.5 AS error")
def append_progress(spark, d):
    p = table(spark, d, "events").select("event_id", F.round("value", 4).alias("error"))
    return p.unionByName(spark.createDataFrame([(-1, 0.5)], "event_id long, error double"))


@query("scan", sql="SELECT pos_id, pos_id % 3 AS grp FROM scan")
def concat_groups(spark, d):
    s = bridge.scan(spark, d)
    groups = [s.where(F.col("pos_id") % 3 == g).select("pos_id", F.lit(g).cast("long").alias("grp")) for g in range(3)]
    return groups[0].unionByName(groups[1]).unionByName(groups[2])


@query(sql="SELECT coalesce(a.user_id, b.user_id) AS user_id, round(coalesce(b.value, a.value), 6) AS value FROM (SELECT user_id, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1) a FULL JOIN (SELECT user_id, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1) b ON a.user_id = b.user_id")
def merge_keys(spark, d):
    one = lambda t: table(spark, d, "events").where(F.col("event_type") == t).groupBy("user_id").agg(F.max("value").alias("value"))
    return rounded(preprocess.overlay(one("click"), one("purchase"), "user_id"))


@query(sql="SELECT c_custkey, round(coalesce(CASE WHEN c_custkey % 7 = 0 THEN 1.0 END, CASE WHEN c_acctbal > 0 THEN c_acctbal END, 0.0), 6) AS value FROM customer")
def init_precedence(spark, d):
    plan, state = F.when(F.col("c_custkey") % 7 == 0, F.lit(1.0)), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    return rounded(table(spark, d, "customer").select("c_custkey", F.coalesce(plan, state, F.lit(0.0)).alias("value")))


@query("jobs", sql="SELECT job_id, status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS n FROM jobs) WHERE n = 1")
def job_last_status(spark, d):
    return control.last_status(_jobs(spark, d), "job_id")


@query("jobs", sql="SELECT user_id, status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM jobs) WHERE n = 1")
def worker_last_status(spark, d):
    return control.last_status(_jobs(spark, d), "user_id")


def _jobs(spark, d):
    return table(spark, d, "events").select((F.col("user_id") % 50).alias("job_id"), "event_id", "ts", F.col("event_type").alias("status"), "value", "user_id")


@query("jobs", sql="SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) - 1 AS i FROM jobs")
def log_seq(spark, d):
    return control.numbered(_jobs(spark, d), "job_id").select("job_id", "event_id", "i")


@query("jobs", sql="SELECT job_id, event_id, i FROM (SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) - 1 AS i FROM jobs) WHERE job_id = 3 AND i >= 5 AND i < 25")
def log_page(spark, d):
    return control.page(control.numbered(_jobs(spark, d).where("job_id = 3"), "job_id"), before=25, limit=20).select("job_id", "event_id", "i")


@query("jobs", sql="SELECT job_id, event_id FROM (SELECT job_id, event_id, ts, lag(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS p FROM jobs) WHERE p IS NULL OR epoch(ts) - epoch(p) > 3600")
def update_gap_filter(spark, d):
    return control.throttled(_jobs(spark, d), "job_id", 3600).select("job_id", "event_id")


@query("jobs", sql="SELECT job_id, event_id, row_number() OVER w - 1 AS i, lag(ts) OVER w IS NULL OR epoch_us(ts) - lag(epoch_us(ts)) OVER w > 3600000000 AS published FROM jobs WHERE ts IS NOT NULL AND event_id IS NOT NULL WINDOW w AS (PARTITION BY job_id ORDER BY ts, event_id)")
def stream_ordered_log(spark, d):
    """The log through a stream to its end: a second source sends one event from far ahead, at which all buckets before it close."""
    folder = f"{shared_folder(spark)}/ordered-log-{uuid.uuid4().hex}"
    spark.range(1).select(F.lit(-1).cast("long").alias("job_id"), F.lit(0).cast("long").alias("event_id"), F.to_timestamp(F.lit("2200-01-01")).alias("ts"), F.lit("end").alias("status")).write.parquet(f"{folder}/end")
    raw = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parque[t]")  # a pattern: a stream takes no plain path of one file
    events = raw.select((F.col("user_id") % 50).cast("long").alias("job_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    stream = merged(events, spark.readStream.schema(events.schema).parquet(f"{folder}/end"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ordered.use_state_store(spark)
    try:
        out = ordered.ordered_log(stream, "job_id", bucket_seconds=6 * 3600, gap_seconds=3600)
        run = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema("job_id long, event_id long, i long, published boolean").parquet(f"{folder}/out").where("job_id >= 0")


@query(sql="SELECT doc_id, CAST(regexp_extract(name, 'x(\\d+)_y(\\d+)', 1) AS BIGINT) AS nx, CAST(regexp_extract(name, 'x(\\d+)_y(\\d+)', 2) AS BIGINT) AS ny FROM (SELECT doc_id, 'scan_x' || doc_id || '_y' || n_chars || '.raw' AS name FROM documents)")
def filename_dims(spark, d):
    name = F.concat(F.lit("scan_x"), F.col("doc_id"), F.lit("_y"), F.col("n_chars"), F.lit(".raw"))
    return table(spark, d, "documents").select("doc_id", *text.filename_dims(name))


@query(sql="SELECT doc_id, v >= [1, 2, 0] AND v <= [1, 9, 5] AS fits FROM (SELECT doc_id, [1, doc_id % 13, doc_id % 7] AS v FROM documents)")
def version_compare(spark, d):
    v = F.concat_ws(".", F.lit("1"), F.col("doc_id") % 13, F.col("doc_id") % 7)
    return table(spark, d, "documents").select("doc_id", text.version_between(v, "1.2.0", "1.9.5").alias("fits"))


@query(sql="SELECT event_id, printf('%02d:%02d:%06.3f', CAST(floor(round(value * 100, 3) / 3600) AS BIGINT), CAST(floor(round(value * 100, 3) / 60) AS BIGINT) % 60, round(value * 100, 3) - 60 * floor(round(value * 100, 3) / 60)) AS hms FROM events")
def duration_format(spark, d):
    return table(spark, d, "events").select("event_id", text.hhmmss(F.round(F.col("value") * 100, 3)).alias("hms"))


@query(sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE event_type WHEN 'click' THEN 'group' WHEN 'purchase' THEN 'iteration' ELSE 'other' END AS kind FROM events")
def message_parse(spark, d):
    kind = F.when(F.col("event_type") == "click", "group").when(F.col("event_type") == "purchase", "iteration").otherwise("other")
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), kind.alias("kind"))


@query(sql="SELECT doc_id, replace(replace(base64(encode(source || '?>~' || lang)), '+', '-'), '/', '_') AS b64, source || '?>~' || lang AS back FROM documents")
def b64_roundtrip(spark, d):
    s = F.concat("source", F.lit("?>~"), "lang")
    b = text.base64_url(s)
    return table(spark, d, "documents").select("doc_id", b.alias("b64"), text.from_base64_url(b).alias("back"))


@query(sql="SELECT vec_id, base64(encode(CAST(label AS VARCHAR))) AS state FROM embeddings")
def state_b64(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.base64(F.col("label").cast("string").cast("binary")).alias("state"))


@query(sql="SELECT doc_id, 'object_phase_iter' || lpad(CAST(doc_id AS VARCHAR), greatest(4, CAST(length(CAST(doc_id AS VARCHAR)) AS INTEGER)), '0') || '.tiff' AS name FROM documents")
def format_name(spark, d):
    return table(spark, d, "documents").select("doc_id", text.output_name("object_phase", F.col("doc_id"), "tiff").alias("name"))


@query(sql="SELECT event_id, epoch_ms(CAST(event_id * 1000 AS BIGINT)) AS at FROM events")
def epoch_timestamp(spark, d):
    return table(spark, d, "events").select("event_id", F.timestamp_seconds("event_id").cast("timestamp_ntz").alias("at"))


@query("scan", sql="SELECT pos_id, y, x FROM (SELECT pos_id, round(y, 6) AS y, round(x, 6) AS x FROM scan)")
def var_projection(spark, d):
    return rounded(control.extract_vars(bridge.scan(spark, d), {"y": "y", "x": "x"}, ["pos_id"]))
