"""From raw documents to token ids: quality, near duplicates, repeated passages, contamination, encoding and decoding.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelex.llm.bpe import bpe_decode, bpe_encode
from tidelex.llm.common import carried_back
from tidelex.llm.decontaminate import decontaminate
from tidelex.llm.graph import stored
from tidelex.llm.minhash import near_duplicates
from tidelex.llm.quality import quality_rules
from tidelex.llm.queries import table, tokenizer_path
from tidelex.llm.suffix import suffix_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and read like the trusted ones.

    A null or empty text fails the base rules and goes; rows without an id are judged by their text; of repeated rows
    all stay or all go; with no label 1 in ``labels`` only the base rules count; no rows give no rows.
    """
    found = quality_rules(docs, table(spark, sf_dir, "labels").where("quality = 1"), carry=True)
    return carried_back(found.where("kept"), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near duplicates; rows without an id stay.

    A text without words is its own group; all rows of one id stay if the id is the smallest of a group of one of
    them; no rows give no rows.
    """
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes that repeat an earlier document.

    A null text becomes empty; rows without an id, and rows of one id among themselves, lose nothing to each other;
    the bytes left of a cut character go with it; no rows give no rows.
    """
    out = carried_back(suffix_dedup(docs, carry=True), docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with less than a twentieth of their words in benchmark windows.

    A null or empty text is clean; an empty benchmark keeps all rows; benchmark items without an id count; repeated
    rows are judged alike; no rows give no rows.
    """
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return carried_back(found.where("NOT contaminated"), docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids: doc_id, n_tokens, ids (little-endian unsigned 32-bit numbers), their SHA-256 and that of the text decoded from them.

    A null or empty text has no ids; rows without an id and repeated rows are encoded too; no rows give no rows.
    """
    decoded = bpe_decode(bpe_encode(docs, tokenizer_path()), tokenizer_path())
    return decoded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", one_of_each_group),
    ("suffix_dedup", without_repeats),
    ("decontamination", uncontaminated),
    ("bpe_encoding", encoded),
]

#: The likelihood ratio, the tokenizer and byte-level cuts through characters have no SQL form; the stages are
#: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
