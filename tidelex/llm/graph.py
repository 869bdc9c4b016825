"""Connected components and stored intermediate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelex.session import scratch


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a new folder below ``spark.checkpoint.dir`` and read it back: a cut in the lineage."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): label is the smallest node that can be reached.

    Every round takes the smallest label among the neighbours and then the label
    of that label, so long chains shrink by halves. All steps are joins and
    aggregates with a map-side part; a node with very many neighbours is one
    skewed join key, which adaptive execution splits. No edges give no rows.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
                    .select("node", F.least("node", "label").alias("label"), F.lit(True).alias("moved")), "labels")
    while labels.where("moved").limit(1).count():
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        labels = stored(step.join(jump, "label").select("node", F.least("label", "far").alias("label"),
                                                        (F.least("label", "far") < F.col("old")).alias("moved")), "labels")
    return labels.select("node", "label")
