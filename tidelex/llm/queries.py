"""The corpus operators over whole test tables, with reference SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.llm.bpe import bpe_decode, bpe_encode
from tidelex.llm.byte_bpe import byte_bpe_decode, byte_bpe_encode, ids_bytes
from tidelex.llm.classifier import quality_scores, train
from tidelex.llm.decontaminate import decontaminate
from tidelex.llm.minhash import near_duplicates
from tidelex.llm.packing import read_tokens, write_tokens
from tidelex.llm.quality import quality_rules
from tidelex.llm.ranked import ranked_search
from tidelex.llm.resample import resample
from tidelex.llm.substring import substring_dedup
from tidelex.llm.suffix import suffix_dedup
from tidelex.llm.token_counts import document_tokens
from tidelex.llm.warc import read_packages, write_packages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def tokenizer_path() -> str:
    """The vocabulary file the queries use; on a cluster it is installed on every machine."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SPACED_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP2_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach AS (SELECT a AS doc_id, a AS r FROM link UNION SELECT reach.doc_id, b FROM reach JOIN link ON r = a),
least AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""

OP4_SQL = rf"""
WITH w AS (SELECT doc_id, {SPACED_WORDS} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
least AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
hit AS (SELECT DISTINCT win.doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (s) WHERE win.doc_id > d),
gone AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
       sha256(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(coalesce(ps, []), p)),
                                             lambda p: ws[p]), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""


@query("op4_substring_dedup", OP4_SQL)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d)),
least AS (SELECT s, min(doc_id) AS d FROM s GROUP BY s),
hit AS (SELECT s.doc_id, p, p - 50 > coalesce(lag(p) OVER (PARTITION BY s.doc_id ORDER BY p), -100) AS fresh
        FROM s JOIN least USING (s) WHERE s.doc_id > d),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b
         FROM (SELECT doc_id, p, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM hit) GROUP BY doc_id, r),
ordered AS (SELECT doc_id, a, b, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
cut AS (SELECT o.doc_id, sum(b - a) AS gone, count(*) AS n, max(b) AS last,
               string_agg(substr(h, 2 * coalesce(before, 0) + 1, 2 * (a - coalesce(before, 0))), '' ORDER BY a) AS kept
        FROM ordered o JOIN d USING (doc_id) GROUP BY o.doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


@query("op9_suffix_dedup", OP9_SQL)
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_minhash_near_dedup", OP2_SQL)
def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, {_PLAIN_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_PLAIN_WORDS} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS s
      FROM (SELECT item_id, ws, least(len(ws), 13) AS k, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS i FROM b WHERE len(ws) > 0)),
widths AS (SELECT DISTINCT k FROM w),
win AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS s
        FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, widths)),
found AS (SELECT win.doc_id, k, i, item_id FROM win JOIN w USING (k, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS l FROM found GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_hit, coalesce(len(l), 0) AS n_items,
       sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op6_benchmark_decontamination", OP6_SQL)
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


@query("op3_token_files")
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_tokens(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)
    return read_tokens(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op7_bpe_round_trip")
def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path())
    return bpe_decode(encoded, tokenizer_path()).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_tokens(table(spark, sf_dir, "documents"), tokenizer_path())


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT html, max(page_id) AS head FROM p GROUP BY html)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> head THEN head END AS refers_to
FROM p JOIN m USING (html)
"""


@query("op1_warc_packages", OP1_SQL)
def op1_warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = write_packages(table(spark, sf_dir, "pages"))
    return read_packages(packages, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality_rules(table(spark, sf_dir, "documents"), trusted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, train(docs, table(spark, sf_dir, "labels")))


def rank_file() -> tuple[str, str]:
    """Rank file and splitting pattern of the byte-level vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op13_byte_bpe")
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = rank_file()
    encoded = byte_bpe_encode(table(spark, sf_dir, "documents"), ranks, pattern)
    return byte_bpe_decode(encoded, ranks).select(
        "doc_id", "n_tokens", F.sha2(ids_bytes(F.col("ids"), ranks), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


OP11_SQL = rf"""
WITH crc AS (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(0, 256)) AS i))),
w AS (SELECT true AS raw, doc_id, {_PLAIN_WORDS} AS ws FROM documents UNION ALL SELECT false, item_id, {_PLAIN_WORDS} FROM benchmark),
f AS (SELECT raw, doc_id, array_to_string(ws[i:i + k - 1], ' ') AS f
      FROM (SELECT raw, doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k))),
n AS (SELECT raw, doc_id, f, count(*) AS n FROM f GROUP BY ALL),
d AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM n)),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda j: ('0x' || substr(h, 2 * j + 1, 2))::BIGINT)),
                                lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295) % 10000 AS b FROM d, crc),
g AS (SELECT b, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain
      FROM (SELECT b, sum(n) FILTER (raw)::DOUBLE AS s0, coalesce(sum(n) FILTER (raw), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT raw), 0)::DOUBLE AS t
            FROM n JOIN b USING (f) GROUP BY b)),
weights AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM n JOIN b USING (f) JOIN g USING (b) WHERE raw GROUP BY doc_id),
scored AS (SELECT doc_id, len(ws) AS n_words, (len(ws) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0))::BIGINT AS n_features,
                  coalesce(weight, 0)::BIGINT AS weight,
                  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
           FROM w LEFT JOIN weights USING (doc_id) WHERE raw),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""


@query("op11_importance_resampling", OP11_SQL)
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM benchmark),
q AS (SELECT item_id, t, count(*) AS q FROM (SELECT item_id, unnest(ws) AS t FROM b) GROUP BY ALL),
all_ AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS l FROM d WHERE len(ws) > 0),
tf AS (SELECT doc_id, t, n, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS t FROM d) SEMI JOIN q USING (t) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, all_ GROUP BY t),
impact AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // l))) AS x FROM tf JOIN weight USING (t), all_),
s AS (SELECT item_id, doc_id, sum(q * x)::BIGINT AS score FROM q JOIN impact USING (t) GROUP BY ALL),
r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM s WHERE score > 0)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM r WHERE r <= 20
"""


@query("op12_ranked_search", OP12_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
