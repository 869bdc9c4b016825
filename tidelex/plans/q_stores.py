"""Registered queries: reconciliation, checks, integrity, mapping, scans and sinks."""

from pyspark.sql import functions as F

from tidelex.operators import integrity as I
from tidelex.operators import mapping as MP
from tidelex.operators import metrics as M
from tidelex.operators import reconcile as RC
from tidelex.operators import validate as VA
from tidelex.plans import views as V
from tidelex.plans.q_metrics import on_raw, on_results
from tidelex.plans.registry import query
from tidelex.schemas import EVENT_KEY
from tidelex.session import scratch
from tidelex.sources import keyfilter as KF
from tidelex.sources import readers as RD
from tidelex.sources import sinks as SK
from tidelex.sources import sync as SY

S = f"WITH {V.V_STORES} "
K = f"WITH {V.V_KEYED} "
P = f"WITH {V.V_POSTS} "
PREFIX = "collector-"
FIELDS = RC.MERGE_FIELDS


def on_stores(name, sql, fn):
    query(name, S + sql)(lambda s, d: fn(V.store_a(s, d), V.store_b(s, d, PREFIX)))


def on_keyed(name, sql, fn):
    query(name, K + sql)(lambda s, d: fn(V.keyed_rows(s, d)))


def on_posts(name, sql, fn):
    query(name, P + sql)(lambda s, d: fn(V.posts(s, d)))


# Reconciliation

DIFF = """(SELECT count(*) FROM store_a) AS total_a, (SELECT count(*) FROM store_b) AS total_b,
  (SELECT count(*) FROM store_a WHERE id NOT IN (SELECT id FROM store_b)) AS a_only,
  (SELECT count(*) FROM store_b WHERE id NOT IN (SELECT id FROM store_a)) AS b_only,
  (SELECT count(*) FROM store_a WHERE id IN (SELECT id FROM store_b)) AS in_both"""
on_stores("rec1_two_store_diff", f"SELECT {DIFF}", lambda a, b: RC.difference(RC.presence(a, b, prefix=PREFIX)))
on_stores("rec2_missing_in_b", """SELECT id AS source_id, posted_at AS occurred_at, md5(selftext) AS body, score FROM store_a
  WHERE id NOT IN (SELECT id FROM store_b)""", lambda a, b: RC.missing_in_b(a, b, "posts", PREFIX).select(
    "source_id", "occurred_at", F.md5(F.get_json_object("payload", "$.selftext")).alias("body"),
    F.get_json_object("payload", "$.score").cast("long").alias("score")))
on_stores("rec3_missing_in_a", """SELECT id, created_utc, subreddit, title, md5(selftext) AS body, author, score, flair_text, over_18
  FROM store_b WHERE id NOT IN (SELECT id FROM store_a)""", lambda a, b: RC.missing_in_a(a, b, PREFIX).select(
    "id", "created_utc", "subreddit", "title", F.md5("selftext").alias("body"), "author", "score", "flair_text", "over_18"))
FILLED = """SELECT a.id, md5(CASE WHEN b.selftext = '' THEN a.selftext ELSE b.selftext END) AS body,
  coalesce(b.author, a.author) AS author, b.score AS score,
  array_to_string(list_sort(list_filter([CASE WHEN b.author IS NULL AND a.author IS NOT NULL THEN 'author' END,
    CASE WHEN b.selftext = '' AND a.selftext <> '' THEN 'selftext' END], lambda x: x IS NOT NULL)), ',') AS filled FROM store_a a JOIN store_b b USING (id)"""
on_stores("rec4_merge_conflicts", FILLED, lambda a, b: RC.merge_conflicts(a, b, PREFIX).select(
    "id", F.md5(F.get_json_object("payload", "$.selftext")).alias("body"),
    F.get_json_object("payload", "$.author").alias("author"),
    F.get_json_object("payload", "$.score").cast("long").alias("score"), "filled"))
on_stores("rec5_report", f"""SELECT *, a_only AS inserted_b, b_only AS exported_a, CAST(0 AS BIGINT) AS resolved, total_a + total_b - in_both AS unique_records,
  100.0::DOUBLE AS coverage_pct, 0.0::DOUBLE AS resolution_pct, a_only > 0 AS a_to_b, b_only > 0 AS b_to_a, false AS merged FROM (SELECT {DIFF})""",
          lambda a, b: RC.report(RC.presence(a, b, prefix=PREFIX), F.col("a_only"), F.col("b_only")))


@query("rec5_reconcile_job", S + f""", f AS ({FILLED}), d AS (SELECT {DIFF})
  SELECT CAST(1 AS BIGINT) AS run, a_only, b_only, in_both, a_only AS inserted_b, b_only AS exported_a,
    (SELECT count(*) FROM f WHERE filled <> '') AS resolved FROM d
  UNION ALL SELECT 2, 0, 0, a_only + b_only + in_both, 0, 0, 0 FROM d""")
def rec5_job(spark, sf_dir):
    """The job runs twice over a mirror and an event table; the second run changes nothing."""
    mirror, events = scratch(spark, "mirror"), scratch(spark, "events")
    SK.append_csv(V.store_a(spark, sf_dir), mirror)
    SK.append_events(V.store_b(spark, sf_dir, PREFIX), events)
    runs = [SY.reconcile(spark, mirror, events, "posts", PREFIX).withColumn("run", F.lit(i)) for i in (1, 2)]
    return runs[0].unionByName(runs[1]).select("run", "a_only", "b_only", "in_both", "inserted_b", "exported_a", "resolved")


on_stores("rec6_dry_run", f"""SELECT *, CAST(0 AS BIGINT) AS inserted_b, CAST(0 AS BIGINT) AS exported_a, CAST(0 AS BIGINT) AS resolved, total_a + total_b - in_both AS unique_records,
  round(in_both * 100.0 / (a_only + b_only + in_both), 6)::DOUBLE AS coverage_pct, 0.0::DOUBLE AS resolution_pct, false AS a_to_b, false AS b_to_a,
  false AS merged FROM (SELECT {DIFF})""", lambda a, b: RC.report(RC.presence(a, b, prefix=PREFIX)))
AGREE = " UNION ALL ".join(f"SELECT '{f}' AS field, avg(CASE WHEN a.{f} IS NOT DISTINCT FROM b.{f} THEN 1.0::DOUBLE ELSE 0 END) AS equal_share FROM j"
                           .replace("a.", "a_").replace("b.", "b_") for f in FIELDS)
on_stores("val7_field_agreement", ", j AS (SELECT " + ", ".join(f"a.{f} AS a_{f}, b.{f} AS b_{f}" for f in FIELDS)
          + f" FROM store_a a JOIN store_b b USING (id)) SELECT field, round(equal_share, 6) AS equal_share FROM ({AGREE})",
          lambda a, b: RC.field_agreement(a, b, PREFIX))
on_stores("doc10_newest_wins", """SELECT a.id, array_to_string(list_sort(list_filter([CASE WHEN a.author IS DISTINCT FROM b.author AND a.author IS NOT NULL THEN 'author' END,
    CASE WHEN a.selftext <> b.selftext THEN 'selftext' END, CASE WHEN a.score <> b.score THEN 'score' END], lambda x: x IS NOT NULL)), ',') AS filled
  FROM store_a a JOIN store_b b USING (id)""", lambda a, b: RC.merge_conflicts(
    a.withColumn("ingested_at", F.timestamp_seconds(F.col("created_utc") + 60)),
    b.withColumn("ingested_at", F.col("occurred_at")), PREFIX, newest_wins=True).select("id", "filled"))


def check_sql(name, checked, failed):
    return f"SELECT '{name}' AS \"check\", ({checked}) AS checked, ({failed}) AS failed"


A_ROWS, B_ROWS = "SELECT count(*) FROM store_a", "SELECT count(*) FROM store_b"
BOTH = A_ROWS + " WHERE id IN (SELECT id FROM store_b)"
A_MISS = A_ROWS + " WHERE id NOT IN (SELECT id FROM store_b)"
B_MISS = B_ROWS + " WHERE id NOT IN (SELECT id FROM store_a)"
CHECKS = {
    "val1_unique_ids": (check_sql("unique_ids", A_ROWS, "SELECT count(*) - count(DISTINCT id) FROM store_a"), lambda a, b: VA.unique_ids(a)),
    "val2_time_agreement": (check_sql("time_agreement", BOTH, "SELECT count(*) FROM store_a a JOIN store_b b USING (id) WHERE abs(a.created_utc - b.created_utc) > 1"),
                            lambda a, b: VA.time_agreement(a, b, PREFIX)),
    "val3_completeness": (check_sql("completeness", A_ROWS, A_MISS), lambda a, b: VA.completeness(a, b, PREFIX)),
    "val4_payload_keys": (check_sql("payload_keys", B_ROWS, "SELECT CAST(0 AS BIGINT)"), lambda a, b: VA.payload_keys(b)),
    "val5_both_way_sync": (check_sql("both_way_sync", f"SELECT ({BOTH}) + ({A_MISS}) + ({B_MISS})", f"SELECT ({A_MISS}) + ({B_MISS})"),
                           lambda a, b: VA.both_way_sync(a, b, PREFIX)),
}
for name, (sql, fn) in CHECKS.items():
    on_stores(name, sql, fn)
on_stores("val6_overall", f"SELECT false AS all_passed, CAST(({A_MISS}) > 0 AS BIGINT) + CAST(({A_MISS}) + ({B_MISS}) > 0 AS BIGINT) AS failed_checks",
          lambda a, b: VA.overall(VA.all_checks(a, b, PREFIX)))
on_results("bld1_live_history_blend", """SELECT source_id, count(*) FILTER (live) AS live_rows,
  round(coalesce(avg(sentiment_score) FILTER (live), avg(sentiment_score) FILTER (NOT live)), 6) AS blended_score
  FROM (SELECT *, occurred_at > TIMESTAMP '2024-01-30 12:00:00' AS live FROM v_results) GROUP BY 1""",
           lambda df: M.live_or_history(df.where("occurred_at > '2024-01-30 12:00:00'"), df.where("occurred_at <= '2024-01-30 12:00:00'"), keys=["source_id"]))
on_results("bld1_date_dimension", """SELECT CAST(d AS TIMESTAMP) AS day, year(d) AS year, month(d) AS month, week(d) AS iso_week, dayname(d) AS weekday
  FROM (SELECT unnest(generate_series(date_trunc('day', min(occurred_at)), date_trunc('day', max(occurred_at)), INTERVAL 1 DAY)) AS d FROM v_results)""",
           M.date_dimension)

# Integrity

UNIQ = """count(*) AS total_records, count(DISTINCT {k}) AS unique_ids, count(*) - count(DISTINCT {k}) AS duplicate_count"""
STATUS = "CASE WHEN count(*) = count(DISTINCT {k}) THEN 'PASS' ELSE 'FAIL' END AS status"
on_keyed("int1_id_uniqueness", f"SELECT {UNIQ.format(k='id')}, {STATUS.format(k='id')} FROM v_keyed", I.id_uniqueness)
on_keyed("int2_duplicate_ids", """SELECT id, count(*) AS occurrence_count, min(ingested_at) AS first_ingested, max(ingested_at) AS last_ingested,
  string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM v_keyed GROUP BY 1 HAVING count(*) > 1""", I.duplicate_ids)
on_keyed("int3_source_uniqueness", f"""SELECT source, {UNIQ.format(k='id')}, CAST(round(CAST(count(DISTINCT id) AS DECIMAL(20, 6)) / count(*) * 100, 2) AS DOUBLE) AS uniqueness_percentage
  FROM v_keyed GROUP BY 1""", I.source_uniqueness)
on_keyed("int4_source_id_uniqueness", f"SELECT {UNIQ.format(k='source_id')}, {STATUS.format(k='source_id')} FROM v_keyed WHERE source = 'A'",
         lambda df: I.source_id_uniqueness(df, "A"))
on_keyed("int5_duplicate_source_ids", """, e AS (SELECT source_id, id, count(*) AS n, min(ingested_at) AS lo, max(ingested_at) AS hi FROM v_keyed WHERE source = 'A' GROUP BY 1, 2),
  p AS (SELECT source_id, CAST(sum(n) AS BIGINT) AS occurrence_count, min(lo) AS first_ingested, max(hi) AS last_ingested, count(*) AS k FROM e GROUP BY 1 HAVING sum(n) > 1)
  SELECT source_id, ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 7))::BIGINT % CAST(ceil(k / 1000) AS BIGINT) AS piece, occurrence_count, first_ingested, last_ingested,
    string_agg(id || CASE WHEN n > 1 THEN ' x' || n ELSE '' END, ', ' ORDER BY id) AS row_ids FROM e JOIN p USING (source_id) GROUP BY 1, 2, 3, 4, 5""",
         lambda df: I.duplicate_source_ids(df, "A"))
on_keyed("int6_duplicate_times", """, n AS (SELECT id, ingested_at, row_number() OVER (PARTITION BY id ORDER BY ingested_at) AS rn FROM v_keyed)
  SELECT date_trunc('hour', ingested_at) AS ingestion_hour, count(*) AS duplicate_records_created, count(DISTINCT id) AS unique_duplicate_ids
  FROM n WHERE rn > 1 GROUP BY 1""", I.duplicate_times)
on_keyed("int7_summary", """SELECT count(*) AS total_records, count(DISTINCT id) AS unique_primary_keys, count(*) - count(DISTINCT id) AS primary_key_duplicates,
  count(*) FILTER (source = 'A') AS source_records, count(DISTINCT source_id) FILTER (source = 'A') AS unique_source_ids,
  count(*) FILTER (source = 'A') - count(DISTINCT source_id) FILTER (source = 'A') AS source_id_duplicates,
  min(ingested_at) AS earliest_record, max(ingested_at) AS latest_record,
  CAST(round(CAST(count(DISTINCT id) AS DECIMAL(20, 6)) / count(*) * 100, 2) AS DOUBLE) AS primary_key_pct,
  CAST(round(CAST(count(DISTINCT source_id) FILTER (source = 'A') AS DECIMAL(20, 6)) / count(*) FILTER (source = 'A') * 100, 2) AS DOUBLE) AS source_id_pct,
  CASE WHEN count(*) <> count(DISTINCT id) THEN 'ISSUES' WHEN count(*) FILTER (source = 'A') = count(DISTINCT source_id) FILTER (source = 'A') THEN 'EXCELLENT' ELSE 'GOOD' END AS overall_status
  FROM v_keyed""", lambda df: I.summary(df, "A"))
on_keyed("int8_advice", """SELECT CASE WHEN EXISTS (SELECT 1 FROM v_keyed GROUP BY id HAVING count(*) > 1) THEN 'PRIMARY KEY DUPLICATES DETECTED'
  WHEN EXISTS (SELECT 1 FROM v_keyed WHERE source = 'A' GROUP BY source_id HAVING count(*) > 1) THEN 'SOURCE_ID DUPLICATES DETECTED'
  ELSE 'NO DUPLICATES FOUND' END AS recommendation""", lambda df: I.advice(df, "A"))

# Mapping

POST = "id, created_utc, {sub} AS subreddit, title, md5(selftext) AS body, {author} AS author, score, upvote_ratio, num_comments, url, {flair} AS flair_text, over_18"


def digest_body(df):
    return df.withColumn("body", F.md5("selftext")).drop("selftext")


on_posts("map1_normalize_submission", "SELECT " + POST.format(sub="lower(subreddit)", author="coalesce(author, '[deleted]')", flair="nullif(flair_text, '')") + " FROM v_posts",
         lambda df: digest_body(MP.normalize_submission(df.withColumn("subreddit", F.upper("subreddit")))))
on_posts("map2_normalize_archive", "SELECT " + POST.format(sub="subreddit", author="coalesce(author, '')", flair="coalesce(flair_text, '')") + " FROM v_posts",
         lambda df: digest_body(MP.normalize_archive(df.withColumnRenamed("flair_text", "link_flair_text"))))
ENVELOPE = """SELECT 'posts' AS source, id AS source_id, posted_at AS occurred_at, false AS processed, title, md5(selftext) AS body, score, author FROM v_posts"""


def opened(df):
    part = lambda key: F.get_json_object("payload", f"$.{key}")
    return df.select("source", "source_id", "occurred_at", "processed", part("title").alias("title"),
                     F.md5(part("selftext")).alias("body"), part("score").cast("long").alias("score"), part("author").alias("author"))


on_posts("map3_to_envelope", ENVELOPE, lambda df: opened(MP.to_envelope(df.select(*V.SUBMISSION_COLUMNS), "posts")))
on_posts("map4_csv_to_envelope", ENVELOPE, lambda df: opened(MP.csv_to_envelope(df, "posts")))
on_posts("map5_envelope_to_submission", "SELECT " + POST.format(sub="subreddit", author="author", flair="flair_text") + " FROM v_posts",
         lambda df: digest_body(MP.envelope_to_submission(MP.to_envelope(df.select(*V.SUBMISSION_COLUMNS), "posts"))))
on_stores("map6_strip_key_prefix", "SELECT id AS source_id FROM store_b",
          lambda a, b: b.select(MP.strip_key_prefix(F.col("source_id"), PREFIX).alias("source_id")))
on_posts("map7_time_repair", "SELECT id, CASE WHEN lang = 'es' THEN NULL ELSE created_utc END AS created_utc FROM v_posts",
         lambda df: df.select("id", MP.repair_time(F.when(F.col("lang") == "de", F.date_format("posted_at", "yyyy-MM-dd HH:mm:ss")).when(
             F.col("lang") == "es", F.lit("not a time")).otherwise(F.col("created_utc").cast("string"))).alias("created_utc")))
on_posts("map8_skip_bad_records", """SELECT CASE WHEN lang = 'fr' THEN 'bad score' WHEN lang = 'es' THEN 'bad created_utc' ELSE 'good' END AS outcome,
  count(*) AS rows FROM v_posts GROUP BY 1""", lambda df: split_counts(df))


def split_counts(df):
    """Spanish posts have no time and French ones a score that is no number."""
    good, bad = MP.split_bad(df.select("id", F.when(F.col("lang") != "es", F.col("created_utc")).alias("created_utc"),
                                       F.when(F.col("lang") == "fr", F.lit("abc")).otherwise(F.col("score").cast("string")).alias("score")))
    good = MP.normalize_archive(good).select(F.lit("good").alias("outcome"))
    return good.unionByName(bad.select(F.col("_reason").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') AS {0}"
on_results("map9_push_row", f"""SELECT event_id, {ISO.format('occurred_at')}, {ISO.format('processed_at')}, source, source_id,
  round(sentiment_score, 6) AS sentiment_score, sentiment_label, round(confidence, 6) AS confidence, model_version FROM v_results""", MP.push_row)

# Scans and sinks


@query("src1_submission_csv", P + "SELECT " + POST.format(sub="subreddit", author="author", flair="nullif(flair_text, '')") + " FROM v_posts")
def src1(spark, sf_dir):
    """Posts written as files and read back with the fixed types; bodies hold line breaks."""
    path = scratch(spark, "csv")
    V.posts(spark, sf_dir).select(*V.SUBMISSION_COLUMNS).write.options(header="true", escape='"', quote='"').csv(path)
    return digest_body(RD.read_submissions(spark, path))


on_raw("src2_event_scan", "SELECT id, source, source_id, occurred_at, payload, ingested_at FROM v_raw WHERE source = 'click'",
       lambda df: RD.event_scan(df, "click"))
on_raw("src3_known_keys", "SELECT DISTINCT source_id AS id FROM v_raw", RD.known_keys)
on_stores("src4_known_keys_all_stores", "SELECT id FROM store_a UNION SELECT id FROM store_b",
          lambda a, b: RD.known_keys_of_all(RD.known_keys(a, "id"), RD.known_keys(
              b.withColumn("source_id", MP.strip_key_prefix(F.col("source_id"), PREFIX)))))


@query("src5_csv_keys", P + "SELECT DISTINCT id FROM v_posts")
def src5(spark, sf_dir):
    path = scratch(spark, "csv")
    V.posts(spark, sf_dir).select(*V.SUBMISSION_COLUMNS).write.options(header="true", escape='"', quote='"').csv(path)
    return RD.csv_keys(spark, path)


@query("snk1_idempotent_append", f"WITH {V.V_RAW} SELECT source, source_id, occurred_at, payload FROM v_raw")
def snk1(spark, sf_dir):
    """All events but the errors, then all events twice: each key is stored once."""
    events = V.raw(spark, sf_dir)
    path = scratch(spark, "events")
    SK.append_events(events.where(F.col("source") != "error"), path)
    SK.append_events(events.unionByName(events), path)
    return RD.read_events(spark, path).select("source", "source_id", "occurred_at", "payload")


@query("snk1_append_counts", f"""WITH {V.V_RAW}, k AS (SELECT source, source_id, occurred_at, count(*) AS n, bool_or(NOT {V.left_out_sql('id', 3, 0)}) AS early FROM v_raw GROUP BY 1, 2, 3),
  c AS (SELECT sum(n)::BIGINT AS rows, count(*) AS keys, count(*) FILTER (early) AS early_keys FROM k),
  e AS (SELECT count(*) FILTER (NOT {V.left_out_sql('id', 3, 0)}) AS early_rows FROM v_raw)
  SELECT CAST(1 AS BIGINT) AS run, early_keys AS inserted, early_rows - early_keys AS skipped FROM c, e
  UNION ALL SELECT 2, keys - early_keys, rows - keys + early_keys FROM c UNION ALL SELECT 3, 0, rows FROM c""")
def snk1_counts(spark, sf_dir):
    """Two thirds of the events, then all, then all again: what each append inserts and skips."""
    events, path = V.raw(spark, sf_dir), scratch(spark, "events")
    parts = (events.where(~V.left_out("id", 3, 0)), events, events)
    return spark.createDataFrame([(i + 1, *SK.append_events(part, path)) for i, part in enumerate(parts)], "run long, inserted long, skipped long")


@query("flt1_stored_keys", f"WITH {V.V_RAW} SELECT DISTINCT source, source_id, occurred_at FROM v_raw WHERE NOT {V.left_out_sql('id', 3, 0)}")
def flt1_stored(spark, sf_dir):
    """Keys of all events that a table of two thirds of them holds, by its key filters and an exact check of what they let through."""
    events, path = V.raw(spark, sf_dir), scratch(spark, "events")
    SK.append_events(events.where(~V.left_out("id", 3, 0)), path)
    asked = SK.with_date(events).select(KF.DATE, *EVENT_KEY).distinct()
    return KF.stored_keys(asked, path, EVENT_KEY)


@query("snk2_bulk_csv_import", ENVELOPE.replace("SELECT", P + "SELECT", 1))
def snk2(spark, sf_dir):
    src, table, bad = (scratch(spark, n) for n in ("csv", "events", "quarantine"))
    V.posts(spark, sf_dir).select(*V.SUBMISSION_COLUMNS).write.options(header="true", escape='"', quote='"').csv(src)
    SK.import_csv(spark, src, table, bad, "posts")
    return opened(RD.read_events(spark, table))


@query("snk3_sorted_csv_mirror", S + """SELECT id, md5(selftext) AS body FROM store_a UNION ALL
  SELECT id, md5(nullif(selftext, '')) FROM store_b WHERE id NOT IN (SELECT id FROM store_a)""")
def snk3(spark, sf_dir):
    root = scratch(spark, "mirror")
    SK.append_csv(V.store_a(spark, sf_dir), root)
    SK.append_csv(MP.envelope_to_submission(V.store_b(spark, sf_dir)), root)
    return digest_body(SK.read_mirror(spark, root)).select("id", "body")


@query("snk4_fan_out", f"WITH {V.V_RAW} SELECT source, count(*) AS rows FROM v_raw GROUP BY 1")
def snk4(spark, sf_dir):
    table, copy = scratch(spark, "events"), scratch(spark, "copy")
    SK.fan_out(V.raw(spark, sf_dir), [lambda df: SK.append_events(df, table), lambda df: df.write.parquet(copy)])
    return spark.read.parquet(copy).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


@query("snk5_columnar_sink", f"WITH {V.V_RAW} SELECT id FROM v_raw WHERE occurred_at >= TIMESTAMP '2024-01-10 06:00:00' AND occurred_at <= TIMESTAMP '2024-01-12 18:00:00'")
def snk5(spark, sf_dir):
    """Write by day, then read a time range: only the days in range are opened."""
    from tidelex.functions.timefn import time_filter
    path = scratch(spark, "columnar")
    SK.write_partitioned(V.raw(spark, sf_dir), path)
    return time_filter(spark.read.parquet(path), "2024-01-10 06:00:00", "2024-01-12 18:00:00").select("id")


on_raw("snk6_day_partitions", "SELECT CAST(CAST(occurred_at AS DATE) AS TIMESTAMP) AS day, count(*) AS rows, CAST(CAST(occurred_at AS DATE) + 1 AS TIMESTAMP) AS next_day FROM v_raw GROUP BY CAST(occurred_at AS DATE)",
       SK.day_partitions)
query("snk6_missing_days", f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE NOT {V.left_out_sql('CAST(o_orderdate AS DATE)', 20, 5)})
  SELECT CAST(g AS TIMESTAMP) AS day FROM (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS g FROM d) WHERE CAST(g AS DATE) NOT IN (SELECT day FROM d)""")(
    lambda s, d: SK.missing_days(V.table(s, d, "orders").withColumn("day", F.to_date("o_orderdate")).where(~V.left_out("day", 20, 5)), "o_orderdate"))


@query("snk7_json_report", f"WITH {V.V_RESULTS} SELECT source, count(*) AS events FROM v_results GROUP BY 1")
def snk7(spark, sf_dir):
    path = scratch(spark, "report")
    SK.write_report(M.count_by(V.results(spark, sf_dir), "source"), path)
    return spark.read.schema("source string, events long").json(path)


@query("snk8_export", f"""WITH {V.V_RESULTS} SELECT id, strftime(occurred_at, '%Y-%m-%d') AS occurred_at, source, source_id,
  round(sentiment_score, 2) AS sentiment_score, sentiment_label, round(confidence, 2) AS confidence FROM v_results""")
def snk8(spark, sf_dir):
    path = scratch(spark, "export")
    SK.export(V.results(spark, sf_dir), path, "csv", with_text=False, digits=2, date_format="yyyy-MM-dd")
    return spark.read.schema("id long, occurred_at string, source string, source_id string, sentiment_score double, "
                             "sentiment_label string, confidence double").option("header", "true").csv(path)


@query("snk8_export_summary", f"""WITH {V.V_RESULTS}, p AS (SELECT sentiment_label AS label, * FROM v_results UNION ALL SELECT 'all', * FROM v_results)
  SELECT label, count(*) AS rows, round(avg(sentiment_score), 2) AS avg_score, strftime(min(occurred_at), '%Y-%m-%d %H:%M:%S') AS first_at,
    strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') AS last_at, round(count(*) / (SELECT count(*) FROM v_results), 2) AS share FROM p GROUP BY 1""")
def snk8_summary(spark, sf_dir):
    """The summary file that stands beside an export."""
    path = scratch(spark, "export")
    SK.export_with_summary(V.results(spark, sf_dir), path, "json", digits=2)
    told = spark.read.schema("label string, rows long, avg_score double, first_at timestamp, last_at timestamp, share double").json(f"{path}/summary")
    return told.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_at", "last_at")})


on_results("snk9_push_batches", """SELECT CAST((rn - 1) // 100 AS BIGINT) AS batch_no, count(*) AS rows_in_batch,
  string_agg(event_id, ',' ORDER BY rn) AS event_ids FROM (SELECT *, row_number() OVER (ORDER BY occurred_at, id) AS rn FROM v_results) GROUP BY 1""",
           lambda df: SK.push_batches(df).select("batch_no", "rows_in_batch", F.array_join(F.transform(
               F.from_json("body", "rows array<struct<event_id: long>>")["rows"], lambda r: r["event_id"].cast("string")), ",").alias("event_ids")))
