"""Registered queries: streaming jobs, retention, and reports described for the product."""

from pyspark.sql import functions as F

from tidelex.operators import metrics as M
from tidelex.operators import results as RE
from tidelex.operators import retention as RT
from tidelex.operators import scoring as SC
from tidelex.operators import series as S
from tidelex.operators import state as ST
from tidelex.operators.filters import unseen
from tidelex.plans import views as V
from tidelex.plans.q_metrics import on_results
from tidelex.plans.q_stores import ENVELOPE, P, opened
from tidelex.plans.q_text import AT, ROUTE, ROUTED, docs, routed, softmax_sql
from tidelex.plans.registry import query
from tidelex.session import scratch
from tidelex.sources import dated as DT
from tidelex.sources.sinks import append_events, record_alerts, with_date, write_partitioned
from tidelex.streaming import fold as FO
from tidelex.streaming import jobs as J
from tidelex.streaming import timers as TM

R = f"WITH {V.V_RESULTS} "


def stream(spark, sf_dir, name):
    """One of the driver's tables as a stream of files. The pattern fits a single file and a folder."""
    schema = V.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def finish(started):
    started.awaitTermination()


# Streaming. Each query runs the stream over all available input.

def analyzed(spark, sf_dir):
    out = scratch(spark, "analyze")
    finish(J.analyze(V.doc_events_of(stream(spark, sf_dir, "documents")), out, scratch(spark, "check"),
                     clock=lambda: F.lit(AT)))
    return out


@query("str1_continuous_analyze", ROUTED + f""" SELECT {ROUTE} AS route, count(*) AS events FROM scored GROUP BY 1""")
def str1(spark, sf_dir):
    out = analyzed(spark, sf_dir)
    parts = [("results", "result"), ("dead_letters", "dead_letter"), ("skipped", "skipped_language")]
    tagged = [spark.read.parquet(f"{out}/{name}").select(F.lit(route).alias("route")) for name, route in parts]
    return tagged[0].union(tagged[1]).union(tagged[2]).groupBy("route").agg(F.count(F.lit(1)).alias("events"))


@query("str1_analyze_metrics", ROUTED + f""" SELECT date_trunc('hour', occurred_at) AS time_bucket, source, source_id, lab AS label,
  count(*) AS n, round(sum(conf), 6) AS score_sum FROM scored WHERE {ROUTE} = 'result' GROUP BY 1, 2, 3, 4""")
def str1_metrics(spark, sf_dir):
    return J.merged_metrics(spark, analyzed(spark, sf_dir))


@query("str2_stream_dedup", R + "SELECT source, source_id, occurred_at FROM v_results")
def str2(spark, sf_dir):
    """The stream is read twice into one table by two runs; every key is stored once."""
    table = scratch(spark, "events")
    for _ in range(2):
        events = V.results_of(stream(spark, sf_dir, "events")).select("id", "source", "source_id", "occurred_at")
        finish(J.start(events, scratch(spark, "check"), lambda df, _: append_events(df, table)))
    return spark.read.parquet(table).select("source", "source_id", "occurred_at")


@query("str2_remembered_keys", R + f""", k AS (SELECT DISTINCT source, source_id, occurred_at, {V.left_out_sql("source_id || epoch_us(occurred_at)", 2, 0)} AS early FROM v_results)
  SELECT CAST(r AS BIGINT) AS run, count(*) FILTER (CASE r WHEN 1 THEN early WHEN 2 THEN NOT early ELSE false END) AS reached FROM k, range(1, 4) t(r) GROUP BY 1""")
def str2_remembered(spark, sf_dir):
    """Half of the keys, then all, then all again on one checkpoint: how many rows reach the sink in each run."""
    landing, check = scratch(spark, "landing"), scratch(spark, "check")
    key = ["source", "source_id", "occurred_at"]
    events = V.results(spark, sf_dir).select(*key).withColumn("k", F.concat("source_id", F.unix_micros("occurred_at").cast("string")))
    reached = []
    for run, rows in enumerate((events.where(V.left_out("k", 2, 0)), events, events), 1):
        rows.write.mode("append").parquet(landing)
        stream = J.without_repeats(spark.readStream.schema(events.schema).parquet(landing), key)
        finish(J.start(stream, check, lambda df, _, run=run: reached.append((run, df.count()))))
    told = spark.createDataFrame(reached + [(r, 0) for r in (1, 2, 3)], "run long, reached long")
    return told.groupBy("run").agg(F.sum("reached").alias("reached"))


@query("str3_continuous_ingest", ENVELOPE.replace("SELECT", P + "SELECT", 1).replace("score, author", "score, coalesce(author, '[deleted]') AS author"))
def str3(spark, sf_dir):
    table, bad = scratch(spark, "events"), scratch(spark, "bad")
    posts = V.posts_of(stream(spark, sf_dir, "documents")).select(*V.SUBMISSION_COLUMNS)
    finish(J.ingest(posts, table, bad, "posts", scratch(spark, "check")))
    return opened(spark.read.parquet(table))


@query("str4_hourly_metrics", R + """SELECT date_trunc('hour', occurred_at) AS time_bucket, source, sentiment_label,
  count(*) AS n, round(sum(sentiment_score), 6) AS score_sum FROM v_results GROUP BY 1, 2, 3""")
def str4(spark, sf_dir):
    """The later part of each day arrives first; the earlier part is late, in a second run on the same checkpoint."""
    landing, out, check = scratch(spark, "landing"), scratch(spark, "metrics"), scratch(spark, "check")
    keys, events = ["source", "sentiment_label"], V.results(spark, sf_dir).select("occurred_at", "source", "sentiment_label", "sentiment_score")
    for part in ("hour(occurred_at) >= 7", "hour(occurred_at) < 7"):
        events.where(part).write.mode("append").parquet(landing)
        finish(J.hourly_metrics(spark.readStream.schema(events.schema).parquet(landing), keys, "sentiment_score", out, check))
    return J.total_per_window(spark, out, keys)


@query("str4_folded_metrics", R + """SELECT date_trunc('hour', occurred_at) AS time_bucket, source, sentiment_label,
  count(*) AS n, round(sum(sentiment_score), 6) AS score_sum FROM v_results GROUP BY 1, 2, 3""")
def str4_folded(spark, sf_dir):
    """Three runs on one checkpoint, each folded into the dated table, the second twice; the last batch stays open."""
    landing, out, check, table = (scratch(spark, n) for n in ("landing", "metrics", "check", "folded"))
    keys, events = ["source", "sentiment_label"], V.results(spark, sf_dir).select("occurred_at", "source", "sentiment_label", "sentiment_score")
    for hours, folds in (("hour(occurred_at) >= 16", 1), ("hour(occurred_at) between 7 and 15", 2), ("hour(occurred_at) < 7", 0)):
        events.where(hours).write.mode("append").parquet(landing)
        finish(J.hourly_metrics(spark.readStream.schema(events.schema).parquet(landing), keys, "sentiment_score", out, check))
        for _ in range(folds):
            FO.fold(spark, out, table)
    return FO.folded(spark, out, table)


@query("str4_fold_days", R + """SELECT CAST(CAST(occurred_at AS DATE) AS VARCHAR) AS day,
  CASE WHEN bool_or(day(occurred_at) % 3 = 0 AND hour(occurred_at) < 12) THEN 2 ELSE 1 END::BIGINT AS version FROM v_results GROUP BY 1""")
def str4_days(spark, sf_dir):
    """The second batch has mornings of every third day: only these days are rewritten."""
    parts, table = scratch(spark, "parts"), scratch(spark, "folded")
    late = (F.day("occurred_at") % 3 == 0) & (F.hour("occurred_at") < 12)
    for batch, rows in enumerate((V.results(spark, sf_dir).where(~late), V.results(spark, sf_dir).where(late))):
        J.windowed_counts(rows, ["source"], "sentiment_score").write.parquet(f"{parts}/batch_id={batch}")
        FO.fold(spark, parts, table)
    return spark.createDataFrame(list(DT.manifest(spark, table).days.items()), "day string, version long")


@query("str5_late_rows", R + "SELECT occurred_at < TIMESTAMP '2024-01-16 00:00:00' AS late, count(*) AS rows FROM v_results GROUP BY 1")
def str5(spark, sf_dir):
    """The second half of the month arrives first; the first half is late."""
    landing, out, check = scratch(spark, "landing"), scratch(spark, "late"), scratch(spark, "check")
    events = V.results(spark, sf_dir).select("id", "occurred_at")
    for half in (events.where("occurred_at >= '2024-01-16'"), events.where("occurred_at < '2024-01-16'")):
        half.write.mode("append").parquet(landing)
        finish(J.split_late(spark.readStream.schema(events.schema).parquet(landing), out, check, 7200))
    return spark.read.parquet(f"{out}/rows").groupBy(F.col("late").cast("boolean").alias("late")).agg(F.count(F.lit(1)).alias("rows"))


@query("str6_idle_sources", R + """SELECT source_id, max(occurred_at) AS gap_start,
  (epoch_us((SELECT max(occurred_at) FROM v_results)) - epoch_us(max(occurred_at))) / 1e6 AS idle_seconds
  FROM v_results GROUP BY 1 HAVING idle_seconds >= 600""")
def str6(spark, sf_dir):
    out = scratch(spark, "idle")
    finish(J.idle_sources(V.results_of(stream(spark, sf_dir, "events")), "source_id", out, scratch(spark, "check")))
    return spark.read.parquet(f"{out}/alarms").select("source_id", "gap_start", "idle_seconds")


@query("str6_idle_timers", R + """SELECT source_id, max(occurred_at) AS gap_start,
  (epoch_us((SELECT max(occurred_at) FROM v_results)) // 1000 * 1000 - epoch_us(max(occurred_at))) / 1e6 AS idle_seconds
  FROM v_results GROUP BY 1 HAVING epoch_us((SELECT max(occurred_at) FROM v_results)) // 1000 >= ceil(epoch_us(max(occurred_at)) / 1000) + 600000""")
def str6_timers(spark, sf_dir):
    """The same stops by a timer for each source."""
    out = scratch(spark, "alarms")
    finish(TM.watch(TM.idle_alarms(V.results_of(stream(spark, sf_dir, "events")), "source_id"), out, scratch(spark, "check")))
    return spark.read.schema("source_id string, gap_start timestamp, idle_seconds double").parquet(out)


@query("str6_all_silent", R + """SELECT source_id, max(occurred_at) AS gap_start,
  (epoch_us(TIMESTAMP '2024-03-01 00:00:00') - epoch_us(max(occurred_at))) / 1e6 AS idle_seconds FROM v_results GROUP BY 1""")
def str6_silent(spark, sf_dir):
    """Nothing arrives any more: two checks by the clock give one alarm for every source."""
    out = scratch(spark, "silent")
    finish(J.idle_sources(V.results_of(stream(spark, sf_dir, "events")), "source_id", out, scratch(spark, "check"), 10**9))
    for _ in range(2):
        J.raise_idle_alarms(spark, out, "source_id", AT)
    return spark.read.parquet(f"{out}/alarms")


@query("clm1_claim_and_record", f"""WITH {V.V_RAW} SELECT id, CAST((row_number() OVER (ORDER BY occurred_at, id) - 1) // 100 AS BIGINT) AS round FROM v_raw
  WHERE NOT coalesce(processed, false) ORDER BY occurred_at, id LIMIT 200""")
def clm1_record(spark, sf_dir):
    """Two claims of 100 events: the second takes the next ones."""
    ledger, events = scratch(spark, "ledger"), V.raw(spark, sf_dir)
    first, second = (J.claim(spark, events, ledger).select("id", F.lit(i).alias("round")) for i in (0, 1))
    return first.unionByName(second)


def claimed(spark, sf_dir):
    """Raw events after two claims of 100 events at a fixed time."""
    ledger, events = scratch(spark, "ledger"), V.raw(spark, sf_dir)
    for _ in range(2):
        J.claim(spark, events, ledger, at=F.lit(CLAIMED_AT))
    return ST.with_claims(events, J.claims(spark, ledger))


CLAIMED_AT = "2024-02-01 00:30:00"
CLAIMED = f"""WITH {V.V_RAW}, c AS (SELECT id, occurred_at FROM v_raw WHERE NOT coalesce(processed, false) ORDER BY occurred_at, id LIMIT 200),
  seen AS (SELECT r.* REPLACE (CASE WHEN c.id IS NOT NULL THEN true ELSE processed END AS processed,
    CASE WHEN c.id IS NOT NULL THEN TIMESTAMP '{CLAIMED_AT}' ELSE processed_at END AS processed_at) FROM v_raw r LEFT JOIN c USING (id, occurred_at))"""


@query("clm2_after_claims", CLAIMED + " SELECT coalesce(CAST(processed AS VARCHAR), 'unknown') AS processed, count(*) AS events, min(occurred_at) AS oldest, max(occurred_at) AS newest FROM seen GROUP BY 1")
def clm2_after(spark, sf_dir):
    return ST.state_summary(claimed(spark, sf_dir)).withColumn("processed", F.coalesce(F.col("processed").cast("string"), F.lit("unknown")))


@query("clm3_after_claims", CLAIMED + """ SELECT count(*) FILTER (NOT coalesce(processed, false)) AS backlog, min(occurred_at) FILTER (NOT coalesce(processed, false)) AS oldest_open,
  count(*) FILTER (processed AND processed_at > TIMESTAMP '2024-02-01 00:00:00' AND processed_at <= TIMESTAMP '2024-02-01 01:00:00') AS processed_last_hour FROM seen""")
def clm3_after(spark, sf_dir):
    return ST.backlog(claimed(spark, sf_dir), "2024-02-01 01:00:00")


@query("clm4_after_claims", CLAIMED + """ SELECT date_trunc('hour', processed_at) AS hour, count(*) AS processed_count FROM seen
  WHERE processed AND processed_at BETWEEN TIMESTAMP '2024-02-01 01:00:00' - INTERVAL 24 HOUR AND TIMESTAMP '2024-02-01 01:00:00' GROUP BY 1""")
def clm4_after(spark, sf_dir):
    return ST.hourly_activity(claimed(spark, sf_dir), "2024-02-01 01:00:00")


@query("str7_gap_triggered_backfill", R + f""", known AS (SELECT * FROM v_results WHERE NOT {V.left_out_sql('id', 4, 1)}),
  last AS (SELECT source_id, max(occurred_at) AS seen FROM known GROUP BY 1)
  SELECT r.id, r.source_id, r.occurred_at FROM v_results r JOIN last l USING (source_id)
  WHERE r.occurred_at >= l.seen AND r.id NOT IN (SELECT id FROM known)
    AND epoch_us((SELECT max(occurred_at) FROM known)) - epoch_us(l.seen) >= 600000000""")
def str7(spark, sf_dir):
    """The idle alarms of the known events start a backfill from the last known time."""
    out = scratch(spark, "idle")
    known_stream = V.results_of(stream(spark, sf_dir, "events")).where(~V.left_out("id", 4, 1))
    finish(J.idle_sources(known_stream, "source_id", out, scratch(spark, "check")))
    # An idle source alarms in every cycle; the last alarm of each says where it stopped.
    alarms = spark.read.parquet(f"{out}/alarms").groupBy("source_id").agg(F.max("gap_start").alias("gap_start"))
    archive = V.results(spark, sf_dir).select("id", "source", "source_id", "occurred_at")
    found = archive.join(alarms, "source_id").where(F.col("occurred_at") >= F.col("gap_start"))
    return unseen(found, archive.where(~V.left_out("id", 4, 1))).select("id", "source_id", "occurred_at")


@query("str8_dead_letter_stream", ROUTED + f""" SELECT CAST(id AS VARCHAR) AS event_id, source_id, occurred_at, '{RE.STAGE_INPUT}' AS processing_component
  FROM scored WHERE {ROUTE} = 'dead_letter'""")
def str8(spark, sf_dir):
    out = analyzed(spark, sf_dir)
    return spark.read.parquet(f"{out}/dead_letters").select("event_id", "source_id", "occurred_at", "processing_component")


@query("str9_push_stream", R + """SELECT CAST((rn - 1) // 100 AS BIGINT) AS batch_no, count(*) AS rows_in_batch
  FROM (SELECT row_number() OVER (ORDER BY occurred_at, id) AS rn FROM v_results) GROUP BY 1""")
def str9(spark, sf_dir):
    out = scratch(spark, "outbox")
    finish(J.push(V.results_of(stream(spark, sf_dir, "events")), out, scratch(spark, "check")))
    return spark.read.schema("batch_no long, rows_in_batch long, body string").json(out).select("batch_no", "rows_in_batch")


@query("doc14_live_trend", R + """SELECT date_trunc('minute', occurred_at) AS time_bucket, source, count(*) AS n,
  round(sum(sentiment_score), 6) AS score_sum FROM v_results
  WHERE date_trunc('minute', occurred_at) BETWEEN TIMESTAMP '2024-01-20 11:00:00' AND TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1, 2""")
def doc14(spark, sf_dir):
    out = scratch(spark, "live")
    finish(J.hourly_metrics(V.results_of(stream(spark, sf_dir, "events")), ["source"], "sentiment_score", out,
                            scratch(spark, "check"), width="1 minute"))
    return J.total_per_window(spark, out, ["source"]).where(
        F.col("time_bucket").between("2024-01-20 11:00:00", "2024-01-20 12:00:00"))


# Retention


@query("ret1_compact", R + """SELECT CAST(CAST(occurred_at AS DATE) AS TIMESTAMP) AS day, count(*) AS rows FROM v_results
  WHERE occurred_at < TIMESTAMP '2024-01-16 00:00:00' GROUP BY 1""")
def ret1(spark, sf_dir):
    """Days older than 90 days on 2024-04-15 are rewritten."""
    path, out = scratch(spark, "hot"), scratch(spark, "compact")
    write_partitioned(V.results(spark, sf_dir), path)
    RT.compact(spark.read.parquet(path), "2024-04-15", out)
    return spark.read.parquet(out).groupBy(F.col("occurred_date").alias("day")).agg(F.count(F.lit(1)).alias("rows"))


@query("ret2_archive_payload", f"WITH {V.V_RAW} SELECT id, payload, occurred_at < TIMESTAMP '2024-01-16 00:00:00' AS archived FROM v_raw")
def ret2(spark, sf_dir):
    """Payloads older than a year on 2025-01-15 are moved out and put back by key."""
    hot, cold = RT.split_payload(V.raw(spark, sf_dir), "2025-01-15")
    restored = RT.restore_payload(hot.withColumn("archived", F.col("payload").isNull()), cold)
    return restored.select("id", "payload", "archived")


@query("ret1_compact_swap", R + "SELECT id, source, occurred_at FROM v_results")
def ret1_swap(spark, sf_dir):
    """A dated table after its older half was compacted in place, twice."""
    table, rows = scratch(spark, "hot"), with_date(V.results(spark, sf_dir).select("id", "source", "occurred_at"))
    DT.replace_days(rows, table, DT.days_of(rows, "occurred_date"))
    for _ in range(2):
        RT.compact_table(table, spark, "2024-04-15")
    return DT.read(spark, table).select("id", "source", "occurred_at")


@query("ret2_archive_job", f"WITH {V.V_RAW} SELECT id, CASE WHEN occurred_at >= TIMESTAMP '2024-01-16 00:00:00' THEN payload END AS hot, payload AS restored FROM v_raw")
def ret2_job(spark, sf_dir):
    """Payloads of the first half of the month are moved to the cold table and the hot dates rewritten."""
    table, cold = scratch(spark, "hot"), scratch(spark, "cold")
    rows = with_date(V.raw(spark, sf_dir))
    DT.replace_days(rows, table, DT.days_of(rows, "occurred_date"))
    RT.archive_payloads(table, cold, spark, "2025-01-15")
    back = RT.restored(spark, table, cold).select("id", F.col("payload").alias("restored"))
    return DT.read(spark, table).select("id", F.col("payload").alias("hot")).join(back, "id")


# Reports

DAILY = ", d AS (SELECT date_trunc('day', occurred_at) AS time_bucket, source, count(*) AS events, avg(sentiment_score) AS score FROM v_results GROUP BY 1, 2)"


def daily(df):
    return df.groupBy(F.date_trunc("day", "occurred_at").alias("time_bucket"), "source").agg(
        F.count(F.lit(1)).alias("events"), F.avg("sentiment_score").alias("score"))


on_results("doc1_period_over_period", DAILY + """ SELECT a.time_bucket, a.source, a.events, round(a.score, 6) AS score, b.events::DOUBLE AS previous,
  (a.events - b.events)::DOUBLE AS change, round((a.events - b.events) * 100.0 / b.events, 6)::DOUBLE AS change_pct
  FROM d a LEFT JOIN d b ON a.source = b.source AND b.time_bucket = a.time_bucket - INTERVAL 1 DAY""",
           lambda df: M.period_over_period(daily(df), ["source"], "time_bucket", "events", "day")
           .withColumns({c: F.col(c).cast("double") for c in ("previous", "change")}))
on_results("doc2_metric_correlation", """, h AS (SELECT date_trunc('hour', occurred_at) AS t, count(*)::DOUBLE AS n, avg(sentiment_score) AS s, avg(confidence) AS c
  FROM v_results GROUP BY 1) SELECT round(corr(n, s), 6) AS volume_score, round(corr(s, c), 6) AS score_confidence FROM h""", S.metric_correlation)
on_results("doc3_anomalies", DAILY + """, z AS (SELECT *, CASE WHEN count(score) OVER w = 7 THEN (score - avg(score) OVER w) / stddev_samp(score) OVER w END AS z
    FROM d WINDOW w AS (PARTITION BY source ORDER BY time_bucket ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
  SELECT time_bucket, source, events, round(score, 6) AS score, round(z, 6) AS z_score, coalesce(abs(z) > 2, false) AS is_anomaly FROM z""",
           lambda df: M.anomalies(daily(df), ["source"], "time_bucket", "score"))
on_results("doc4_threshold_alerts", DAILY + """ SELECT time_bucket, source, events, round(score, 6) AS score, 'low score' AS rule FROM d WHERE score < -0.2
  UNION ALL SELECT time_bucket, source, events, round(score, 6), 'busy and negative' FROM d WHERE events > 60 AND score < 0""",
           lambda df: M.threshold_alerts(daily(df), [("low score", "score < -0.2"), ("busy and negative", "events > 60 AND score < 0")]))


@query("doc4_alert_history", R + DAILY + """ SELECT time_bucket, source, 'negative' AS rule,
  CASE WHEN time_bucket < TIMESTAMP '2024-01-20 00:00:00' THEN TIMESTAMP '2024-01-20 00:00:00' ELSE TIMESTAMP '2024-02-01 00:00:00' END AS raised_at FROM d WHERE score < 0""")
def doc4_history(spark, sf_dir):
    """Alerts of the data until the 20th, then of all, then of all again: each is raised once."""
    path, buckets = scratch(spark, "alerts"), daily(V.results(spark, sf_dir))
    early = buckets.where("time_bucket < '2024-01-20'")
    for rows, at in ((early, "2024-01-20"), (buckets, "2024-02-01"), (buckets, "2024-02-02")):
        record_alerts(M.threshold_alerts(rows, [("negative", "score < 0")]).select("time_bucket", "source", "rule"), path, ["time_bucket", "source", "rule"], at)
    return spark.read.parquet(path)


@query("doc6_model_comparison", f"""WITH {softmax_sql('documents', 'text')},
  b AS (SELECT doc_id, lab AS label_a, CASE WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' ELSE 'neutral' END AS label_b
    FROM (SELECT doc_id, lab, (p - q) / sqrt((p - q) * (p - q) + 15) AS c FROM (SELECT doc_id, lab, lp * scale / 4 AS p, ln * scale / 4 AS q FROM scored)))
  SELECT label_a, label_b, count(*) AS events FROM b GROUP BY 1, 2""")
def doc6(spark, sf_dir):
    text = docs(spark, sf_dir)
    a = SC.classify(text, "text").select(F.col("doc_id").alias("event_id"), F.col("label").alias("sentiment_label"))
    b = SC.with_compound(text, "text").select(F.col("doc_id").alias("event_id"), F.col("compound_label").alias("sentiment_label"))
    return M.label_agreement(a, b)


@query("doc7_metric_rebuild", R + """SELECT date_trunc('hour', occurred_at) AS time_bucket, source, source_id, sentiment_label AS label,
  count(*) AS n, round(sum(sentiment_score), 6) AS score_sum FROM v_results GROUP BY 1, 2, 3, 4""")
def doc7(spark, sf_dir):
    """Metrics are rebuilt from the results, date by date, over the affected partitions."""
    path = scratch(spark, "rebuilt")
    metric = M.hourly_metric(V.results(spark, sf_dir), "occurred_at")
    (metric.withColumn("bucket_date", F.to_date("time_bucket")).repartitionByRange("bucket_date", "source", "source_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket_date").parquet(path))
    return spark.read.parquet(path).drop("bucket_date")


@query("doc7_affected_days", R + """SELECT date_trunc('hour', occurred_at) AS time_bucket, source, source_id, sentiment_label AS label, count(*) AS n,
  round(sum(CASE WHEN source = 'click' AND day(occurred_at) < 6 THEN -sentiment_score ELSE sentiment_score END), 6) AS score_sum,
  CASE WHEN CAST(occurred_at AS DATE) IN (SELECT CAST(occurred_at AS DATE) FROM v_results WHERE source = 'click' AND day(occurred_at) < 6) THEN 2 ELSE 1 END::BIGINT AS version
  FROM v_results GROUP BY 1, 2, 3, 4, 7""")
def doc7_affected(spark, sf_dir):
    """Clicks of the first days are corrected: the metrics of their days are rebuilt, all others keep their version."""
    parts, table, rows = scratch(spark, "parts"), scratch(spark, "folded"), V.results(spark, sf_dir)
    M.hourly_metric(rows, "occurred_at").write.parquet(f"{parts}/batch_id=0")
    FO.fold(spark, parts, table)
    wrong = (F.col("source") == "click") & (F.day("occurred_at") < 6)
    right = rows.withColumn("sentiment_score", F.when(wrong, -F.col("sentiment_score")).otherwise(F.col("sentiment_score")))
    FO.rebuild(M.hourly_metric(right, "occurred_at"), table, rows.where(wrong))
    held = spark.createDataFrame(list(DT.manifest(spark, table).days.items()), "day string, version long")
    return FO.folded(spark, parts, table).withColumn("day", F.to_date("time_bucket").cast("string")).join(held, "day").drop("day")


@query("doc8_dead_letter_replay", ROUTED + f""" SELECT id, CAST(2 AS BIGINT) AS attempts, 'dead_letter' AS route FROM scored WHERE {ROUTE} = 'dead_letter'""")
def doc8(spark, sf_dir):
    letters = RE.dead_letters(routed(spark, sf_dir), AT)
    schema = "id long, source string, source_id string, occurred_at timestamp, payload string, content string"
    return RE.route_events(RE.replayable(letters, schema)).select("id", "attempts", "route")


on_results("doc9_error_rate", """SELECT date_trunc('minute', occurred_at) AS minute, count(*) AS errors FROM v_results GROUP BY 1 HAVING count(*) > 1""",
           lambda df: M.error_rate(df.withColumnRenamed("occurred_at", "failed_at"), 1))
on_results("doc11_age_bins", """SELECT CAST(floor((epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(occurred_at)) / 1e6 / 86400 / 7) AS BIGINT) AS age_bin,
  count(*) AS rows FROM v_results GROUP BY 1""", lambda df: M.age_bins(df, "2024-02-01 00:00:00"))
for size in ("day", "week", "month"):
    on_results(f"doc13_rolled_up_{size}", f"""SELECT date_trunc('{size}', occurred_at) AS time_bucket, source, source_id, sentiment_label AS label,
      count(*) AS n, round(sum(sentiment_score), 6) AS score_sum FROM v_results GROUP BY 1, 2, 3, 4""",
               lambda df, size=size: M.roll_up(M.roll_up(M.hourly_metric(df, "occurred_at"), "day"), size))
