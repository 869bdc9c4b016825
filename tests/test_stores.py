"""Sinks, mapping, reconciliation, paging, retention."""

import json
import time
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidelex.operators import integrity as I
from tidelex.operators import mapping as MP
from tidelex.operators import paging as P
from tidelex.operators import reconcile as RC
from tidelex.operators import retention as RT
from tidelex.operators import validate as VA
from tidelex.schemas import SUBMISSION, SUBMISSION_COLUMNS
from tidelex.sources import readers as RD
from tidelex.sources import sinks as SK

POST = ("abc", 1609459200.0, "stocks", "T", "body\nline \"q\"", "u", 42, 0.75, 10, "link", "DD", False)


def posts(spark, *changes):
    rows = [tuple(dict(zip(SUBMISSION_COLUMNS, POST)) | c for _ in "x")[0] for c in changes]
    return spark.createDataFrame([tuple(r[c] for c in SUBMISSION_COLUMNS) for r in rows], SUBMISSION)


@pytest.mark.parametrize("epoch,want", [(946684800.0, datetime(2000, 1, 1)), (1893456000.0, datetime(2030, 1, 1)),
                                        (1625097600.123456, datetime(2021, 7, 1, 0, 0, 0, 123456))])
def test_epoch_edges(spark, epoch, want):
    assert MP.to_envelope(posts(spark, {"created_utc": epoch}), "s").collect()[0].occurred_at == want


def test_normalize(spark):
    row = MP.normalize_submission(posts(spark, {"author": None, "subreddit": "StockS", "flair_text": ""})).collect()[0]
    assert (row.author, row.subreddit, row.flair_text) == ("[deleted]", "stocks", None)


def test_time_repair(spark):
    df = spark.createDataFrame([("1609459200.5",), ("2021-01-01 00:00:00",), ("bad",), (None,)], "t string")
    assert [r[0] for r in df.select(MP.repair_time(F.col("t"))).collect()] == [1609459200.5, 1609459200.0, None, None]


def test_envelope_defaults_and_present_null(spark):
    df = spark.createDataFrame([("k1", datetime(2024, 1, 1), '{"title": null, "score": "7"}')], "source_id string, occurred_at timestamp, payload string")
    row = MP.envelope_to_submission(df).collect()[0]
    assert (row.id, row.title, row.selftext, row.score, row.upvote_ratio) == ("k1", None, "", 7, 0.0)
    assert row.created_utc == 1704067200.0


def test_append_is_idempotent(spark, tmp_path):
    table = str(tmp_path / "events")
    batch = MP.to_envelope(posts(spark, {}, {"id": "x"}, {"id": "x"}), "s")
    assert SK.append_events(batch, table) == (2, 1)
    assert SK.append_events(batch, table) == (0, 3)
    later = MP.to_envelope(posts(spark, {"created_utc": 1609545600.0}), "s")
    assert SK.append_events(later, table) == (1, 0)
    assert RD.read_events(spark, table).count() == 3


def test_csv_mirror_keeps_stored_rows_and_orders_by_time(spark, tmp_path):
    root = str(tmp_path / "mirror")
    SK.append_csv(posts(spark, {"id": "a", "title": "old", "created_utc": 20.0}), root)
    assert SK.append_csv(posts(spark, {"id": "a", "title": "new"}, {"id": "b", "created_utc": 10.0}), root) == 2
    rows = RD.read_submissions(spark, f"{root}/version-2").collect()
    assert [(r.id, r.title, r.selftext) for r in rows] == [("b", "T", POST[4]), ("a", "old", POST[4])]
    (tmp_path / "mirror" / "version-3").mkdir()
    assert SK.latest_version(spark, root) == 2


def test_import_sends_bad_rows_to_quarantine(spark, tmp_path):
    from pyspark.sql import types as T
    loose = T.StructType([T.StructField(f.name, T.StringType() if f.name == "created_utc" else f.dataType, True) for f in SUBMISSION])
    src, table, bad = (str(tmp_path / n) for n in ("src", "t", "bad"))
    rows = posts(spark, {}, {"id": "x"}).withColumn("created_utc", F.when(F.col("id") == "x", F.lit("junk")).otherwise(F.lit("1609459200")))
    rows.write.options(header="true", escape='"').csv(src)
    assert SK.import_csv(spark, src, table, bad, "s", loose) == (1, 0, 1)
    assert spark.read.parquet(bad).collect()[0]._reason == "bad created_utc"


def test_failing_sink_does_not_stop_others(spark):
    got = []

    def fail(df):
        raise RuntimeError("down")

    assert SK.fan_out(spark.range(3), [fail, lambda df: got.append(df.count()) or "second"]) == "second"
    assert got == [3]
    with pytest.raises(RuntimeError):
        SK.fan_out(spark.range(1), [fail])


@pytest.mark.parametrize("n,batches", [(1, [1]), (75, [75]), (150, [100, 50])])
def test_push_batches(spark, n, batches):
    df = spark.range(n).select("id", F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("occurred_at"),
                               F.timestamp_seconds("id").alias("processed_at"), *[F.lit("s").alias(c) for c in (
                                   "source", "source_id", "sentiment_label", "model_version")],
                               F.lit(0.5).alias("sentiment_score"), F.lit(None).cast("double").alias("confidence"))
    rows = SK.push_batches(df).orderBy("batch_no").collect()
    assert [r.rows_in_batch for r in rows] == batches
    assert json.loads(rows[0].body)["rows"][0]["occurred_at"] == "1970-01-01T00:00:00.000000"


def test_reconcile_until_nothing_differs(spark):
    a = posts(spark, {"id": "1"}, {"id": "2", "title": "from a"}, {"id": "2"}, {"id": "3", "score": 0})
    b = MP.to_envelope(posts(spark, {"id": "2", "title": "", "author": None, "score": 0}, {"id": "3", "score": 0, "title": "kept"}, {"id": "4"}), "s")
    b = b.withColumn("source_id", F.concat(F.lit("pre-"), F.col("source_id")))
    assert RC.difference(RC.presence(a, b, prefix="pre-")).collect()[0].asDict() == {
        "total_a": 4, "total_b": 3, "a_only": 1, "b_only": 1, "in_both": 2}
    merged = {r.id: r for r in RC.merge_conflicts(a.dropDuplicates(["id", "title"]).where("id <> '2' or title = 'from a'"), b, "pre-").collect()}
    assert merged["2"].filled == "author,title" and json.loads(merged["2"].payload)["title"] == "from a"
    assert json.loads(merged["2"].payload)["score"] == 0 and merged["3"].filled == ""
    assert json.loads(merged["3"].payload)["title"] == "kept"
    full_b = b.select("source", "source_id", "occurred_at", "payload").unionByName(
        RC.missing_in_b(a, b, "s", "pre-").select("source", "source_id", "occurred_at", "payload"))
    full_a = a.unionByName(RC.missing_in_a(a, b, "pre-"))
    after = RC.difference(RC.presence(full_a, full_b, prefix="pre-")).collect()[0]
    assert (after.a_only, after.b_only) == (0, 0)
    checks = {r.check: r.passed for r in VA.all_checks(full_a, full_b, "pre-").collect()}
    assert checks == {"unique_ids": False, "time_agreement": True, "completeness": True, "payload_keys": True, "both_way_sync": True}


def test_unknown_payload_keys_survive_a_merge(spark):
    a = posts(spark, {"id": "1", "title": "t"})
    b = spark.createDataFrame([("s", "1", datetime(2021, 1, 1), '{"id":"1","title":"","extra":{"deep":[1,2]}}')],
                              "source string, source_id string, occurred_at timestamp, payload string")
    payload = json.loads(RC.merge_conflicts(a, b).collect()[0].payload)
    assert payload["extra"] == {"deep": [1, 2]} and payload["title"] == "t"


def test_validation_of_empty_stores(spark):
    a = posts(spark, {}).limit(0)
    b = MP.to_envelope(a, "s")
    assert all(r.passed for r in VA.all_checks(a, b).collect())


def test_long_id_lists_stay_whole(spark):
    df = spark.range(2500).select("id", F.lit("A").alias("source"), F.lit("hot").alias("source_id"), F.timestamp_seconds("id").alias("ingested_at"))
    rows = I.duplicate_source_ids(df, "A").collect()
    ids = sorted(int(i) for r in rows for i in r.row_ids.split(", "))
    assert len(rows) == 3 and ids == list(range(2500)) and {r.occurrence_count for r in rows} == {2500}


def test_cursor_roundtrip_and_errors():
    when = datetime(2024, 1, 1, 2, 3, 4, 5)
    assert P.decode_cursor(P.encode_cursor(when, 9)) == (when, 9)
    for bad in ("zzz", "e30=", ""):
        with pytest.raises(ValueError):
            P.decode_cursor(bad)


def test_pages_cover_all_rows_once(spark):
    df = spark.range(50).select("id", F.timestamp_seconds(F.floor(F.col("id") / 3)).alias("occurred_at"), F.lit("s").alias("source"))
    seen, cursor = [], None
    while True:
        page = P.keyset_page(df, 7, cursor).collect()
        if not page:
            break
        seen += [r.id for r in page]
        cursor = P.encode_cursor(page[-1].occurred_at, page[-1].id)
    assert seen == sorted(range(50), reverse=True)


def test_payload_archive_roundtrip(spark):
    df = spark.createDataFrame([(1, datetime(2020, 1, 1), "old"), (2, datetime(2024, 1, 1), "new")], "id long, occurred_at timestamp, payload string")
    hot, cold = RT.split_payload(df, "2024-06-01")
    assert [r.payload for r in hot.orderBy("id").collect()] == [None, "new"] and cold.count() == 1
    assert sorted(map(tuple, RT.restore_payload(hot, cold).collect())) == sorted(map(tuple, df.collect()))


def test_bad_numbers_are_quarantined(spark, tmp_path):
    """A record with a number that cannot be read is set aside with its reason; the others arrive complete."""
    folder = str(tmp_path / "csv")
    rows = [(str(i), "1700000000", "G", "t", "b", "a", "abc" if i == 3 else "5", "0.5", "x" if i == 4 else "1", "u", "", "false") for i in range(6)]
    spark.createDataFrame(rows, ", ".join(f"{c} string" for c in SUBMISSION_COLUMNS)).write.options(header="true").csv(folder)
    table, bad = str(tmp_path / "events"), str(tmp_path / "bad")
    assert SK.import_csv(spark, folder, table, bad, "s") == (4, 0, 2)
    assert {r._reason for r in spark.read.parquet(bad).collect()} == {"bad score", "bad num_comments"}
    from tidelex.operators import metrics as M
    from tidelex.sources import readers as RD
    events = RD.read_events(spark, table)
    assert RD.event_scan(events, "s").where("ingested_at IS NOT NULL").count() == 4
    assert M.ingest_lag(events).agg({"event_count": "sum"}).first()[0] == 4


def test_piece_of_ids_with_a_common_factor(spark):
    """Ids that are multiples of 1,000 do not meet in one piece."""
    from tidelex.operators import integrity as I
    df = spark.range(20_000).select((F.col("id") * 1000).alias("id"), F.lit("A").alias("source"), F.lit("hot").alias("source_id"),
                                    F.timestamp_seconds("id").alias("ingested_at"))
    sizes = [len(r.row_ids.split(", ")) for r in I.duplicate_source_ids(df, "A").collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 1300


def test_letters_past_the_limit_are_kept_apart(spark):
    from tidelex.operators import results as RE
    letters = spark.createDataFrame([("{}", 1), ("{}", 3)], "event_payload string, attempts int")
    assert RE.replayable(letters, "id long", 3).count() == 1 == RE.exhausted(letters, 3).count()


def test_all_checks_equal_the_single_ones(spark):
    """One pass over both stores counts what the checks count one by one, with repeats, null ids and a null payload."""
    a = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 5.0), ("z", 9.0), (None, 1.0), (None, 2.0)], "id string, created_utc double")
    full = '{"id": 1, "created_utc": 1, "subreddit": 1, "title": 1, "author": null}'
    b = spark.createDataFrame([("p-x", 1, full), ("p-y", 60, full), ("p-w", 1, "{}"), (None, 1, None), ("p-w", 2, full)],
                              "source_id string, s int, payload string").withColumn("occurred_at", F.timestamp_seconds("s"))
    want = [VA.unique_ids(a), VA.time_agreement(a, b, "p-"), VA.completeness(a, b, "p-"), VA.payload_keys(b), VA.both_way_sync(a, b, "p-")]
    got = {r.check: (r.checked, r.failed) for r in VA.all_checks(a, b, "p-").collect()}
    assert got == {r.check: (r.checked, r.failed) for part in want for r in part.collect()}
    plan = VA.all_checks(a, b, "p-")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2


def test_archive_defaults_stand_for_missing_values_only(spark):
    df = spark.createDataFrame([("a", "7", None), ("b", "abc", "x"), ("c", None, "")], "id string, score string, title string")
    got = {r.id: (r.score, r.title, r.num_comments, r.over_18) for r in MP.normalize_archive(df).collect()}
    assert got == {"a": (7, "", 0, False), "b": (None, "x", 0, False), "c": (0, "", 0, False)}


def test_reconcile_reads_the_event_table_once(spark, tmp_path, monkeypatch):
    """The first run copies the table; the second one finds nothing to do."""
    from tidelex.sources import sync
    mirror, table = str(tmp_path / "mirror"), str(tmp_path / "events")
    SK.append_csv(posts(spark, {"id": "a"}, {"id": "b"}, {"id": "c", "created_utc": 1609545600.0}), mirror)
    SK.append_events(MP.to_envelope(posts(spark, {"id": "b", "author": None}, {"id": "d", "created_utc": 1609632000.0}), "s"), table)
    read, load = [], type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *paths, **kw: read.append(paths[0]) or load(self, *paths, **kw))
    row = sync.reconcile(spark, mirror, table, "s").collect()[0]
    assert (row.a_only, row.b_only, row.in_both, row.inserted_b, row.exported_a, row.resolved) == (2, 1, 1, 2, 1, 1)
    assert read.count(table) == 1
    events = RD.read_events(spark, table)
    assert {(r.source_id, json.loads(r.payload)["author"]) for r in events.collect()} == {(k, "u") for k in "abcd"}
    row = sync.reconcile(spark, mirror, table, "s").collect()[0]
    assert (row.a_only, row.b_only, row.in_both, row.inserted_b, row.exported_a, row.resolved) == (0, 0, 4, 0, 0, 0)


def shuffle_files(spark):
    told = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in told.split("\n") if "/shuffle_" in f}


def test_reconcile_leaves_no_copies_and_no_shuffle_files(spark, tmp_path):
    """What a step stored or shuffled goes with the step; the stores, narrow checkpoints and the session's settings stay."""
    from tidelex.session import shared_folder
    from tidelex.sources import sync
    mirror, table = str(tmp_path / "mirror"), str(tmp_path / "events")
    folder, settings = Path(shared_folder(spark)), spark.conf.getAll
    before, shuffled = {f.name for f in folder.iterdir()}, shuffle_files(spark)
    SK.append_csv(posts(spark, {"id": "a"}, {"id": "b"}, {"id": "b"}, {"id": "c", "created_utc": 1609545600.0}), mirror)
    SK.append_events(MP.to_envelope(posts(spark, {"id": "b", "author": None}, {"id": "d"}, {"id": "d"}), "s"), table)
    row = sync.reconcile(spark, mirror, table, "s").collect()[0]
    assert (row.a_only, row.b_only, row.in_both, row.inserted_b, row.exported_a, row.resolved) == (2, 1, 1, 2, 1, 1)
    assert {f.name for f in folder.iterdir()} == before
    until = time.time() + 20
    while shuffle_files(spark) - shuffled and time.time() < until:
        time.sleep(0.2)
    left = shuffle_files(spark) - shuffled
    # Those of the report and of jobs that are not queries at most.
    assert len({f.rsplit("/", 1)[1].split("_")[1] for f in left}) <= 1, left
    assert spark.conf.getAll == settings


@pytest.mark.parametrize("few", [500_000, 0])
def test_reconcile_of_many_days_in_slices(spark, tmp_path, monkeypatch, few):
    """Repeated ids and an unreadable payload; dates are replaced slice by slice, with ids sent or shuffled."""
    from tidelex.sources import sync
    monkeypatch.setattr(SK, "FEW", few)
    monkeypatch.setattr(sync, "ROWS_OF_SLICE", 3)
    mirror, table = str(tmp_path / "mirror"), str(tmp_path / "events")
    day = lambda i: 1609459200.0 + 86400 * i
    a = [{"id": f"k{i}", "created_utc": day(i), "author": f"u{i}", "title": f"a{i}"} for i in range(20) if i % 5]
    b = [{"id": f"k{i}", "created_utc": day(i), "author": None if i % 2 else "own", "title": f"b{i}"} for i in range(20) if i % 7]
    SK.append_csv(posts(spark, *a, *a[:3]), mirror)
    events = MP.to_envelope(posts(spark, *b, *b[:4]), "s").withColumn("source_id", F.concat(F.lit("pre-"), "source_id"))
    events = events.withColumn("payload", F.when(F.col("source_id") == "pre-k2", F.lit("no json")).otherwise(F.col("payload")))
    SK.append_events(events, table)
    row = sync.reconcile(spark, mirror, table, "s", "pre-").collect()[0]
    assert (row.a_only, row.b_only, row.in_both, row.inserted_b, row.exported_a) == (2, 3, 14, 2, 3)
    assert row.resolved == sum(1 for i in range(20) if i % 5 and i % 7 and i % 2) + 1  # and the one that is no JSON
    got = {r.source_id: json.loads(r.payload) if r.payload != "no json" else None for r in RD.read_events(spark, table, key_prefix="pre-").collect()}
    assert sorted(got) == sorted(f"k{i}" for i in range(1, 20)) and RD.read_events(spark, table).count() == 19
    for i in range(20):
        if i % 7 and i != 2:
            assert got[f"k{i}"]["title"] == f"b{i}"
            assert got[f"k{i}"]["author"] == (f"u{i}" if i % 2 and i % 5 else None if i % 2 else "own")
    kept = {r.id: r.title for r in SK.read_mirror(spark, mirror).collect()}
    assert kept == {f"k{i}": f"a{i}" if i % 5 else f"b{i}" for i in range(1, 20)}
    row = sync.reconcile(spark, mirror, table, "s", "pre-").collect()[0]
    assert (row.a_only, row.b_only, row.in_both, row.inserted_b, row.exported_a, row.resolved) == (0, 0, 19, 0, 0, 1)


@pytest.mark.parametrize("few", [500_000, 0])
def test_mirror_merges_repeated_and_null_ids(spark, tmp_path, monkeypatch, few):
    """Files are compressed; a version of plain files is read as before. An id that is null is an id like others."""
    monkeypatch.setattr(SK, "FEW", few)
    root = str(tmp_path / "mirror")
    first = posts(spark, {"id": "a", "created_utc": 30.0}, {"id": "b", "title": "late", "created_utc": 20.0}, {"id": "b", "title": "early", "created_utc": 10.0})
    first.write.options(header="true", escape='"', quote='"').csv(f"{root}/version-1")
    nulls = posts(spark, {"id": "x", "created_utc": 2.0, "title": "second"}, {"id": "x", "created_utc": 1.0, "title": "first"})
    new = posts(spark, {"id": "a", "title": "new"}, {"id": "c", "created_utc": 15.0}).unionByName(nulls.withColumn("id", F.lit(None).cast("string")))
    assert SK.append_csv(new, root) == 2
    rows = RD.read_submissions(spark, f"{root}/version-2").collect()
    assert [(r.id, r.title, r.selftext) for r in rows] == [
        (None, "first", POST[4]), ("b", "early", POST[4]), ("c", "T", POST[4]), ("a", "T", POST[4])]
    assert all(f.name.endswith(".csv.gz") for f in Path(root, "version-2").glob("part-*"))


@pytest.mark.parametrize("few", [500_000, 1])
@pytest.mark.parametrize("copies", [1, 2, 5])
def test_append_picks_rows_by_number(spark, tmp_path, monkeypatch, few, copies):
    """None, some or most rows of a batch are repeats."""
    monkeypatch.setattr(SK, "FEW", few)
    table = str(tmp_path / "events")
    once = MP.to_envelope(posts(spark, *[{"id": f"k{i}", "created_utc": 1609459200.0 + 40000 * i} for i in range(6)]), "s").select("source", "source_id", "occurred_at", "payload")
    batch = once
    for _ in range(copies - 1):
        batch = batch.unionByName(once)
    batch = batch.unionByName(once.limit(1))
    assert SK.append_events(batch, table) == (6, 6 * copies - 5)
    assert sorted(r.source_id for r in RD.read_events(spark, table).collect()) == [f"k{i}" for i in range(6)]
