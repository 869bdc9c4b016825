"""Registered queries: gaps, freshness, processing state, windows, searches, filters."""

from pyspark.sql import functions as F

from tidelex.operators import filters as FL
from tidelex.operators import gaps as G
from tidelex.operators import search as SE
from tidelex.operators import state as ST
from tidelex.operators import windows as W
from tidelex.plans import views as V
from tidelex.plans.q_metrics import on_raw, on_results
from tidelex.plans.registry import query
from tidelex.session import scratch
from tidelex.sources import termindex as TI
from tidelex.sources.fill import fill_gaps
from tidelex.sources.sinks import append_events

AS_OF = "2024-01-30 12:00:00"
TERMS = ["worthless", "pathetic", "moron", "nicht", "avec", "para"]
DAY = 86_400


def gap_sql(view: str, keys: str, min_gap: int, ts: str = "occurred_at") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    cols = f"{keys}, " if keys else ""
    return f"""SELECT {cols}prev AS gap_start, {ts} AS gap_end, (epoch_us({ts}) - epoch_us(prev)) / 1e6 AS gap_duration_seconds
      FROM (SELECT {cols}{ts}, lag({ts}) OVER ({part}ORDER BY {ts}) AS prev FROM {view})
      WHERE epoch_us({ts}) - epoch_us(prev) > {min_gap * 1_000_000}"""


# Gaps

on_results("gap1_group_gaps", gap_sql("v_results", "source_id", 600), lambda df: G.group_gaps(df, "source_id"))
on_results("gap1_group_gaps_one_day", gap_sql("v_results", "source_id", DAY),
           lambda df: G.group_gaps(df, "source_id", min_gap=DAY))
on_results("gap2_table_gaps", gap_sql("v_results", "", 600), G.table_gaps)
on_results("gap2_largest_gaps", gap_sql("v_results", "", 600) + " ORDER BY gap_duration_seconds DESC, gap_start LIMIT 10",
           lambda df: G.largest(G.table_gaps(df), 10))
on_results("gap3_recent_gaps", f"SELECT * FROM ({gap_sql('v_results', '', 600)}) WHERE gap_end > (SELECT max(occurred_at) - INTERVAL 1 DAY FROM v_results)",
           G.recent_gaps)
on_results("gap4_newest", "SELECT id, occurred_at FROM v_results ORDER BY occurred_at DESC, id DESC LIMIT 5",
           lambda df: G.newest(df.select("id", "occurred_at"), 5, "occurred_at", "id"))
query("gap5_last_time", f"WITH {V.V_POSTS} SELECT coalesce(max(created_utc), 0) AS last_epoch FROM v_posts")(
    lambda s, d: G.last_time(V.posts(s, d)))
on_results("gap6_staleness", f"""SELECT source_id, max(occurred_at) AS last_at,
  (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(occurred_at))) / 1e6 AS age_seconds,
  (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(occurred_at))) / 1e6 >= 600 AS is_gap
  FROM v_results GROUP BY 1""", lambda df: G.staleness(df, AS_OF, "source_id"))
on_results("gap7_fill_plan", f"""SELECT *, row_number() OVER (ORDER BY gap_duration_seconds DESC, gap_start, source_id) AS fill_rank,
  greatest(1, CAST(floor(gap_duration_seconds / 86400) AS BIGINT)) AS window_days FROM ({gap_sql('v_results', 'source_id', 3600)})""",
           lambda df: G.fill_plan(G.group_gaps(df, "source_id", min_gap=3600), "source_id"))
GAP8 = f"""WITH {V.V_RESULTS}, known AS (SELECT * FROM v_results WHERE NOT {V.left_out_sql('id', 4, 1)}),
  gaps AS ({gap_sql('known', 'source_id', DAY)})
  SELECT r.id, r.source_id, r.occurred_at, g.gap_start, g.gap_end FROM v_results r JOIN gaps g
    ON r.source_id = g.source_id AND r.occurred_at BETWEEN g.gap_start AND g.gap_end
  WHERE r.id NOT IN (SELECT id FROM known)"""


@query("gap8_fill_from_archive", GAP8)
def gap_fill(spark, sf_dir):
    """The store misses a quarter of the events; the gaps this leaves are filled from the whole table."""
    archive = V.results(spark, sf_dir).select("id", "source", "source_id", "occurred_at")
    known = archive.where(~V.left_out("id", 4, 1))
    gaps = G.group_gaps(known, "source_id", min_gap=DAY)
    return G.fill_from_archive(known, archive, gaps, "source_id").select(
        "id", "source_id", "occurred_at", "gap_start", "gap_end")


MISSING = f"""missing AS (SELECT r.id, r.source_id, r.occurred_at, g.gap_start, NOT {V.left_out_sql('id', 8, 1)} AS by_time,
    contains(lower(raw_text), 'click') OR contains(lower(raw_text), 'page') AS by_term
  FROM v_results r JOIN gaps g ON r.source_id = g.source_id AND r.occurred_at BETWEEN g.gap_start AND g.gap_end WHERE r.id NOT IN (SELECT id FROM known)),
  found AS (SELECT * FROM missing WHERE by_time OR by_term)"""


@query("gap8_fill_job", f"""WITH {V.V_RESULTS}, known AS (SELECT * FROM v_results WHERE NOT {V.left_out_sql('id', 4, 1)}),
  gaps AS ({gap_sql('known', 'source_id', DAY)}), {MISSING},
  after AS (SELECT source_id, occurred_at FROM known UNION ALL SELECT source_id, occurred_at FROM found),
  gaps2 AS ({gap_sql('after', 'source_id', DAY)}),
  n AS (SELECT source_id, count(*) AS gaps, sum(gap_duration_seconds) AS gap_seconds FROM gaps GROUP BY 1),
  f AS (SELECT source_id, count(*) FILTER (by_time) AS time_rows, count(*) FILTER (NOT by_time) AS term_rows, count(DISTINCT gap_start) AS filled_gaps FROM found GROUP BY 1)
  SELECT CAST(1 AS BIGINT) AS run, source_id, gaps, gap_seconds, coalesce(time_rows, 0) AS time_rows, coalesce(term_rows, 0) AS term_rows, coalesce(filled_gaps, 0) AS filled_gaps
  FROM n LEFT JOIN f USING (source_id)
  UNION ALL SELECT 2, source_id, count(*), sum(gap_duration_seconds), 0, 0, 0 FROM gaps2 GROUP BY source_id""")
def gap_fill_job(spark, sf_dir):
    """The job runs twice. The time search misses an eighth of the events, the term search reads all."""
    events, path = V.results(spark, sf_dir).select("id", "source", "source_id", "occurred_at", "raw_text"), scratch(spark, "events")
    append_events(events.where(~V.left_out("id", 4, 1)), path)
    runs = [fill_gaps(spark, path, events.where(~V.left_out("id", 8, 1)), "source_id", ["click", "page"], events, F.col("raw_text"), DAY)
            .withColumn("run", F.lit(i)) for i in (1, 2)]
    return runs[0].unionByName(runs[1])


@query("gap8_filled_table", f"""WITH {V.V_RESULTS}, known AS (SELECT * FROM v_results WHERE NOT {V.left_out_sql('id', 4, 1)}),
  gaps AS ({gap_sql('known', 'source_id', DAY)}), {MISSING}
  SELECT id, source_id, raw_text FROM v_results WHERE id IN (SELECT id FROM known UNION ALL SELECT id FROM found)""")
def gap_filled(spark, sf_dir):
    """The event table after the job."""
    events, path = V.results(spark, sf_dir).select("id", "source", "source_id", "occurred_at", "raw_text"), scratch(spark, "events")
    append_events(events.where(~V.left_out("id", 4, 1)), path)
    fill_gaps(spark, path, events.where(~V.left_out("id", 8, 1)), "source_id", ["click", "page"], events, F.col("raw_text"), DAY)
    return spark.read.parquet(path).select("id", "source_id", "raw_text")


on_raw("gap9_collection_counters", f"""SELECT unnest(['rows', 'known_keys', 'fetch_age_seconds', 'data_gap_seconds']) AS metric,
  unnest([n, k, age, gap]) AS value, unnest([false, false, age > 1200, false]) AS alert FROM (
    SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT id) AS DOUBLE) AS k,
      (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(ingested_at))) / 1e6 AS age,
      (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(max(occurred_at))) / 1e6 AS gap FROM v_raw)""",
       lambda df: G.collection_counters(df, "2024-02-01 00:00:00"))

# Processing state

on_raw("clm1_claim_oldest", """SELECT id, occurred_at FROM v_raw WHERE NOT coalesce(processed, false)
  AND id NOT IN (SELECT id FROM v_raw WHERE source = 'view') ORDER BY occurred_at, id LIMIT 100""",
       lambda df: ST.claim_oldest(df, df.where(F.col("source") == "view")).select("id", "occurred_at"))
on_raw("clm2_state_summary", """SELECT coalesce(CAST(processed AS VARCHAR), 'unknown') AS processed, count(*) AS events, min(occurred_at) AS oldest, max(occurred_at) AS newest
  FROM v_raw GROUP BY 1""", lambda df: ST.state_summary(df).withColumn(
    "processed", F.coalesce(F.col("processed").cast("string"), F.lit("unknown"))))
on_raw("clm3_backlog", f"""SELECT count(*) FILTER (NOT coalesce(processed, false)) AS backlog,
  min(occurred_at) FILTER (NOT coalesce(processed, false)) AS oldest_open,
  count(*) FILTER (processed AND processed_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR AND processed_at <= TIMESTAMP '{AS_OF}') AS processed_last_hour
  FROM v_raw""", lambda df: ST.backlog(df, AS_OF))
on_raw("clm4_hourly_activity", f"""SELECT date_trunc('hour', processed_at) AS hour, count(*) AS processed_count FROM v_raw
  WHERE processed AND processed_at BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND TIMESTAMP '{AS_OF}' GROUP BY 1""",
       lambda df: ST.hourly_activity(df, AS_OF))
on_raw("clm6_freshness", """SELECT round(avg(CASE WHEN epoch_us(processed_at) - epoch_us(ingested_at) <= 3600000000 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share_in_time,
  round(count(*) / count(DISTINCT date_trunc('minute', processed_at)), 6) AS mean_per_minute FROM v_raw WHERE processed""",
       ST.freshness)

# Filters

query("flt1_unseen", f"WITH {V.V_POSTS} SELECT id FROM v_posts WHERE doc_id NOT IN (SELECT doc_id FROM labels)")(
    lambda s, d: FL.unseen(V.posts(s, d), V.table(s, d, "labels"), "doc_id").select("id"))
on_results("flt2_closed_range", """SELECT id, occurred_at FROM v_results
  WHERE epoch_us(occurred_at) // 1000000 BETWEEN 1704326400 AND 1704931199""",
           lambda df: FL.closed_range(df, 1704326400, 1704931199).select("id", "occurred_at"))
on_results("flt3_result_filters", """SELECT id FROM v_results WHERE occurred_at >= TIMESTAMP '2024-01-04 00:00:00'
  AND occurred_at <= TIMESTAMP '2024-01-26 00:00:00' AND source = 'click' AND sentiment_label = 'positive'""",
           lambda df: FL.result_filters(df, "2024-01-04 00:00:00", "2024-01-26 00:00:00", "click", label="positive").select("id"))
on_results("flt4_advanced_filters", """SELECT id, raw_text FROM v_results WHERE sentiment_score BETWEEN -0.5 AND 0.5
  AND confidence >= 0.1 AND length(raw_text) BETWEEN 13 AND 18 AND regexp_matches(raw_text, '(?i)VIEW|click')
  AND NOT regexp_matches(raw_text, '(?i)"k": ?9')""", lambda df: FL.advanced_filters(
    df, (-0.5, 0.5), 0.1, (13, 18), ["VIEW", "click"], ['"k": ?9']).select("id", "raw_text"))
on_raw("flt5_unprocessed", "SELECT id FROM v_raw WHERE NOT coalesce(processed, false)",
       lambda df: FL.unprocessed(df).select("id"))


@query("flt6_entity_existed", f"""WITH {V.V_RESULTS}, created AS (SELECT source_id, min(occurred_at) AS created_at FROM v_results GROUP BY 1),
  periods AS (SELECT DISTINCT source_id, date_trunc('day', occurred_at) - INTERVAL 1 DAY AS period_end FROM v_results)
  SELECT p.* FROM periods p JOIN created c USING (source_id) WHERE c.created_at <= p.period_end""")
def existed(spark, sf_dir):
    df = V.results(spark, sf_dir)
    created = df.groupBy("source_id").agg(F.min("occurred_at").alias("created_at"))
    periods = df.select("source_id", (F.date_trunc("day", "occurred_at") - F.expr("INTERVAL 1 DAY")).alias("period_end")).distinct()
    return FL.entity_existed(periods, created, "source_id")


# Searches

HAY = "lower(title || ' ' || selftext)"
TERM_LIST = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
P = f"WITH {V.V_POSTS} "


def searched(spark, sf_dir):
    return V.posts_of(V.table(spark, sf_dir, "documents"))


def on_posts(name, sql, fn):
    posts = searched if name.startswith("sea") else V.posts
    query(name, P + sql)(lambda s, d: fn(posts(s, d)))


@query("sea1_term_search", P + f"""SELECT id, term FROM (SELECT *, unnest({TERM_LIST}) AS term FROM v_posts)
  WHERE contains({HAY}, term) AND posted_at BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-18 00:00:00'
  AND doc_id NOT IN (SELECT doc_id FROM labels)""")
def sea1(spark, sf_dir):
    posts = searched(spark, sf_dir)
    seen = V.table(spark, sf_dir, "labels").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"))
    return SE.term_search(posts, TERMS, "2024-01-02 00:00:00", "2024-01-18 00:00:00", seen).select("id", "term")


INDEX_TERMS = ["worthless", "avec les", "para", "xqzv"]
INDEX_LIST = "[" + ", ".join(f"'{t}'" for t in INDEX_TERMS) + "]"


@query("sea1_indexed_search", P + f"SELECT id, term FROM (SELECT *, unnest({INDEX_LIST}) AS term FROM v_posts) WHERE contains({HAY}, term)")
def sea1_indexed(spark, sf_dir):
    """The archive is written in blocks with a trigram index, in two runs; the search reads the blocks that can hold a term."""
    path, df = scratch(spark, "archive"), V.posts(spark, sf_dir)
    for part in (~V.left_out("id", 2, 0), V.left_out("id", 2, 0)):
        TI.add_posts(df.where(part), path, 500)
    return TI.indexed_search(spark, path, INDEX_TERMS).select("id", "term")


on_posts("sea2_date_search", """SELECT id, subreddit FROM v_posts WHERE subreddit = 'src3'
  AND posted_at BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-18 00:00:00'""",
         lambda df: SE.date_search(df, "2024-01-02 00:00:00", "2024-01-18 00:00:00", "src3").select("id", "subreddit"))
on_posts("sea3_year_search", """SELECT id, y AS search_year FROM (SELECT *, unnest([year(posted_at) - 1, year(posted_at)]) AS y FROM v_posts)
  WHERE posted_at BETWEEN make_timestamp(y, 1, 1, 0, 0, 0) AND make_timestamp(y + 1, 1, 1, 0, 0, 0)""",
         lambda df: SE.with_search_years(df).select("id", "search_year"))
FIRST_TERM = f"list_filter({TERM_LIST}, lambda t: contains({HAY}, t))[1]"
on_posts("sea4_term_sweep", f"""SELECT id, CASE WHEN posted_at <= TIMESTAMP '2024-01-01 00:00:00' THEN 'year 2023'
    ELSE 'term ' || {FIRST_TERM} END AS found_by FROM v_posts
  WHERE posted_at <= TIMESTAMP '2024-01-01 00:00:00' OR {FIRST_TERM} IS NOT NULL""",
         lambda df: SE.term_sweep(df, TERMS, 2008, 2023).select("id", "found_by"))
on_posts("sea4_term_counts", f"""SELECT {FIRST_TERM} AS term, count(*) AS posts FROM v_posts WHERE {FIRST_TERM} IS NOT NULL GROUP BY 1""",
         lambda df: df.select(SE.first_matched_term(SE.searchable(df), TERMS).alias("term")).where("term is not null")
         .groupBy("term").agg(F.count(F.lit(1)).alias("posts")))

# One row per group: its first and last year; its windows have two months.
YEARS = "SELECT subreddit, year(min(posted_at)) AS y0, year(max(posted_at)) + 1 AS y1 FROM v_posts GROUP BY 1"
WIN1 = f""", y AS ({YEARS}), w AS (SELECT subreddit, y1,
    make_timestamp(y0, 1, 1, 0, 0, 0) + to_months(CAST(m AS INTEGER)) AS window_start,
    make_timestamp(y0, 1, 1, 0, 0, 0) + to_months(CAST(m + {{step}} AS INTEGER)) AS e
    FROM (SELECT *, unnest(range(0, (y1 - y0) * 12, {{step}})) AS m FROM y)),
  windows AS (SELECT subreddit, window_start, CASE WHEN year(e) >= y1 THEN make_timestamp(y1, 1, 1, 0, 0, 0) ELSE e END AS window_end FROM w)"""


def group_years(df):
    return df.groupBy("subreddit").agg(F.year(F.min("posted_at")).alias("y0"), (F.year(F.max("posted_at")) + 1).alias("y1"))


on_posts("win1_month_windows", WIN1.format(step=5) + " SELECT * FROM windows",
         lambda df: W.month_windows(group_years(df), "y0", "y1", 5).select("subreddit", "window_start", "window_end"))
on_posts("sea5_window_search", WIN1.format(step=2) + f""" SELECT id, window_start, terms FROM (
    SELECT p.id, w.window_start, array_to_string(list_filter({TERM_LIST}, lambda t: contains({HAY}, t)), ',') AS terms,
      row_number() OVER (PARTITION BY p.id ORDER BY w.window_start) AS rn
    FROM v_posts p JOIN windows w ON p.subreddit = w.subreddit AND p.posted_at BETWEEN w.window_start AND w.window_end) WHERE rn = 1""",
         lambda df: SE.window_search(df, W.month_windows(group_years(df), "y0", "y1", 2).select(
             "subreddit", "window_start", "window_end"), ["subreddit"], TERMS)
         .select("id", "window_start", F.array_join("terms", ",").alias("terms")))

SPAN = "SELECT subreddit, min(posted_at) AS lo, max(posted_at) AS hi FROM v_posts GROUP BY 1"
WIN2 = f""", sp AS ({SPAN}), n AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil((epoch_us(hi) - epoch_us(lo)) / 1e6 / ({{days}} * 86400)) AS BIGINT)))) AS window_no FROM sp),
  windows AS (SELECT subreddit, window_no, greatest(hi - to_days(CAST((window_no + 1) * {{days}} AS INTEGER)), lo) AS window_start,
    hi - to_days(CAST(window_no * {{days}} AS INTEGER)) AS window_end FROM n)"""


def group_span(df):
    return df.groupBy("subreddit").agg(F.min("posted_at").alias("lo"), F.max("posted_at").alias("hi"))


def backward(df, days):
    return W.backward_windows(group_span(df), "lo", "hi", days).select("subreddit", "window_no", "window_start", "window_end")


on_posts("win2_backward_windows", WIN2.format(days=3) + " SELECT * FROM windows WHERE window_start < window_end",
         lambda df: backward(df, 3))
on_posts("sea6_window_sweep_fallback", WIN2.format(days=4) + f""", prim AS (SELECT * FROM v_posts WHERE {V.left_out_sql('id', 5, 2)}),
  direct AS (SELECT p.id, w.subreddit, w.window_no, 'time' AS found_by FROM prim p JOIN windows w ON p.subreddit = w.subreddit
    AND p.posted_at BETWEEN w.window_start AND w.window_end WHERE w.window_start < w.window_end),
  hits AS (SELECT p.id, w.subreddit, w.window_no, unnest(list_filter(range(1, {len(TERMS) + 1}), lambda i: contains({HAY}, {TERM_LIST}[i]))) AS r
    FROM v_posts p JOIN windows w ON p.subreddit = w.subreddit AND p.posted_at BETWEEN w.window_start AND w.window_end
    WHERE w.window_end >= w.window_start + INTERVAL 3 DAY
      AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.subreddit = w.subreddit AND d.window_no = w.window_no)),
  best AS (SELECT subreddit, window_no, min(r) AS r FROM hits GROUP BY 1, 2),
  found AS (SELECT * FROM direct UNION ALL SELECT h.id, h.subreddit, h.window_no, 'term ' || {TERM_LIST}[h.r] FROM hits h JOIN best b
    USING (subreddit, window_no, r))
  SELECT id, window_no, found_by FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY window_no) AS rn FROM found) WHERE rn = 1""",
         lambda df: SE.window_sweep_with_fallback(df.where(V.left_out("id", 5, 2)), df, backward(df, 4), TERMS)
         .select("id", "window_no", "found_by"))
on_posts("win3_forward_chunks", f""", sp AS (SELECT subreddit, date_trunc('day', min(posted_at)) AS lo, max(posted_at) AS hi FROM v_posts GROUP BY 1)
  SELECT subreddit, lo + to_months(CAST(m AS INTEGER)) AS chunk_start, least(lo + to_months(CAST(m + 3 AS INTEGER)), hi) AS chunk_end
  FROM (SELECT *, unnest(range(0, 1200, 3)) AS m FROM sp) WHERE lo + to_months(CAST(m AS INTEGER)) < hi""",
         lambda df: W.forward_chunks(df.groupBy("subreddit").agg(F.date_trunc("day", F.min("posted_at")).alias("lo"), F.max("posted_at").alias("hi")), "lo", "hi", 3)
         .select("subreddit", "chunk_start", "chunk_end"))
on_posts("win4_adaptive_chunks", f""", sp AS (SELECT *, (epoch_us(hi) - epoch_us(lo)) // 86400000000 AS d FROM ({SPAN})),
  c AS (SELECT *, greatest(1, CASE WHEN d <= 7 THEN d WHEN d <= 30 THEN least(10, d // 3) ELSE least(20, d // 7) END) AS chunk_count FROM sp)
  SELECT subreddit, chunk_count, k AS chunk_no,
    make_timestamp(epoch_us(lo) + CAST(round((epoch_us(hi) - epoch_us(lo)) * k / chunk_count) AS BIGINT)) AS chunk_start,
    make_timestamp(epoch_us(lo) + CAST(round((epoch_us(hi) - epoch_us(lo)) * (k + 1) / chunk_count) AS BIGINT)) AS chunk_end
  FROM (SELECT *, unnest(range(0, chunk_count)) AS k FROM c)""",
         lambda df: W.adaptive_chunks(group_span(df), "lo", "hi").select("subreddit", "chunk_count", "chunk_no", "chunk_start", "chunk_end"))
on_results("win5_backfill_extent", """, f AS (SELECT source_id, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(occurred_at) - 1) // 86400000000 AS w, count(*) AS n
    FROM v_results GROUP BY 1, 2),
  p AS (SELECT *, coalesce(lag(w) OVER (PARTITION BY source_id ORDER BY w), -1) AS prev FROM f),
  s AS (SELECT source_id, coalesce(min(prev + 3) FILTER (w - prev > 3), max(w) + 3) AS last_window FROM p GROUP BY 1)
  SELECT s.source_id, last_window, count(f.w) AS windows_with_rows, coalesce(CAST(sum(f.n) AS BIGINT), 0) AS rows_collected
  FROM s LEFT JOIN f ON f.source_id = s.source_id AND f.w <= last_window GROUP BY 1, 2""",
           lambda df: W.backfill_extent(df, "source_id", "occurred_at", "2024-02-01 00:00:00", 1))
on_results("win5_backfill_rows", """, f AS (SELECT *, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(occurred_at) - 1) // 86400000000 AS window_no FROM v_results),
  p AS (SELECT source_id, w, coalesce(lag(w) OVER (PARTITION BY source_id ORDER BY w), -1) AS prev FROM (SELECT DISTINCT source_id, window_no AS w FROM f)),
  s AS (SELECT source_id, coalesce(min(prev + 3) FILTER (w - prev > 3), max(w) + 3) AS last_window FROM p GROUP BY 1)
  SELECT id, source_id, window_no FROM f JOIN s USING (source_id) WHERE window_no <= last_window""",
           lambda df: W.backfill_rows(df, "source_id", "occurred_at", "2024-02-01 00:00:00", 1).select("id", "source_id", "window_no"))
on_results("win6_gap_days", f"""SELECT source_id, gap_start, greatest(1, CAST(floor(gap_duration_seconds / 86400) AS BIGINT)) AS window_days
  FROM ({gap_sql('v_results', 'source_id', 3600)})""",
           lambda df: G.group_gaps(df, "source_id", min_gap=3600).select(
               "source_id", "gap_start", W.gap_days(F.col("gap_duration_seconds")).alias("window_days")))
