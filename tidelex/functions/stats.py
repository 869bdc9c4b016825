"""Sample moments and exact percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelex.session import materialize


def sample_skewness(col: Column) -> Column:
    """Bias-corrected skewness; null below three values."""
    n = F.count(col).cast("double")
    return F.when(n >= 3, F.skewness(col) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(col: Column) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = F.count(col).cast("double")
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(col) + 6))


#: Steps of a power of two in the first pass, and of a bin in the second.
COARSE, FINE = 256, 65_536
#: Statistics that the first pass gives beside the percentiles.
ALSO = ("rows", "count", "mean", "min", "max", "variance", "skewness", "kurtosis")


def with_bin(df: DataFrame, value: str, name: str = "_bin", steps: int = COARSE) -> DataFrame:
    """A whole number that never decreases as ``value`` grows; null for null.

    Each power of two is cut into ``steps`` equal steps, so the number of bins
    depends on the spread of magnitudes and not on the number of rows. Infinities
    have the end bins, and what is not a number comes after them. The parts stand
    in projections of their own: each is computed once a row.
    """
    v = F.col(value)
    endless = F.isnan(v) | (F.abs(v) == float("inf"))
    size = df.withColumn("_size", F.when(endless | (v == 0), F.lit(1.0)).otherwise(F.abs(v)))
    octave = size.withColumn("_octave", F.greatest(F.floor(F.log2("_size")), F.lit(-1000)))
    key = octave.withColumn("_key", ((F.col("_octave") + 1100) * steps + F.floor(
        (F.col("_size") / F.pow(F.lit(2.0), F.col("_octave")) - 1) * steps)).cast("long"))
    end = F.lit(1 << 62)
    return key.withColumn(name, F.when(v.isNull(), F.lit(None)).when(F.isnan(v), end + 1).when(endless, F.when(v > 0, end).otherwise(-end))
                          .when(v == 0, F.lit(0)).when(v > 0, F.col("_key")).otherwise(-F.col("_key")).cast("long")).drop("_size", "_octave", "_key")


def _first_pass(rows: DataFrame, group: list[str], shape: bool) -> DataFrame:
    """Counts, sums and extremes per bin, and with ``shape`` central moments; written out, so that it is one scan."""
    v = F.col("_v")
    aggs = [F.count(F.lit(1)).alias("_n"), F.avg(v).alias("_mean"), F.min(v).alias("_lo"), F.max(v).alias("_hi")]
    if shape:
        aggs += [F.var_pop(v).alias("_var"), F.skewness(v).alias("_skew"), F.kurtosis(v).alias("_kurt")]
    return materialize(rows.groupBy(*group, "_bin").agg(*aggs))


def _totals(hist: DataFrame, group: list[str], also: tuple[str, ...]) -> DataFrame:
    """Statistics of each group from those of its bins."""
    there = F.col("_bin").isNotNull()
    whole = Window.partitionBy(*group)
    n = F.when(there, F.col("_n")).otherwise(0)
    told = hist.withColumn("_k", n).withColumn("_d", F.col("_mean") - F.try_divide(
        F.sum(F.col("_k") * F.col("_mean")).over(whole), F.sum("_k").over(whole)))
    aggs = {"rows": F.sum("_n"), "count": F.sum("_k"), "min": F.min("_lo"), "max": F.max("_hi"),
            "mean": F.try_divide(F.sum(F.col("_k") * F.col("_mean")), F.sum("_k"))}
    if {"variance", "skewness", "kurtosis"} & set(also):
        k, d = F.col("_k"), F.col("_d")
        two = k * F.col("_var")
        three = F.coalesce(k * F.col("_skew") * F.pow("_var", F.lit(1.5)), F.lit(0.0))
        four = F.coalesce(k * (F.col("_kurt") + 3) * F.col("_var") * F.col("_var"), F.lit(0.0))
        sums = [F.sum(two + k * d * d), F.sum(three + 3 * d * two + k * d * d * d),
                F.sum(four + 4 * d * three + 6 * d * d * two + k * d * d * d * d)]
        m = F.sum("_k").cast("double")
        skew = F.try_divide(F.sqrt(m) * sums[1], F.pow(sums[0], F.lit(1.5)))
        kurt = F.try_divide(m * sums[2], sums[0] * sums[0]) - 3
        aggs |= {"variance": F.when(m > 1, sums[0] / (m - 1)), "skewness": F.when(m >= 3, skew * F.sqrt(m * (m - 1)) / (m - 2)),
                 "kurtosis": F.when(m >= 4, (m - 1) / ((m - 2) * (m - 3)) * ((m + 1) * kurt + 6))}
    return told.groupBy(*group).agg(*[aggs[a].alias(a) for a in also])


def exact_percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], also: tuple[str, ...] = ()) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per key; ``also`` names statistics of ``ALSO``.

    The built-in exact percentile keeps every distinct value of a group in one
    task. Here a first pass counts a coarse histogram, whose length does not
    depend on the number of rows, and finds the bins that hold the wanted ranks. A
    second pass counts the values of those bins only, cut again into fine steps, so
    that no more than a step's values are put in order at once. Groups without a
    value have null percentiles if ``also`` is given, else no row. Null keys are
    left out.
    """
    group = list(keys) or ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(0))
    base = base.select(*group, F.col(value).cast("double").alias("_v"))
    for key in group:
        base = base.where(F.col(key).isNotNull())
    rows = with_bin(base if also else base.where(F.col("_v").isNotNull()), "_v")
    hist = _first_pass(rows, group, bool({"variance", "skewness", "kurtosis"} & set(also)))

    upto = Window.partitionBy(*group).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    binned = (hist.where(F.col("_bin").isNotNull()).withColumn("_upto", F.sum("_n").over(upto))
              .withColumn("_total", F.sum("_n").over(Window.partitionBy(*group)))
              .withColumn("_before", F.col("_upto") - F.col("_n")))
    ranks = []
    for name, p in probs.items():
        position = F.lit(float(p)) * (F.col("_total") - 1)
        low = F.floor(position)
        for side, rank in (("lo", low), ("hi", F.ceil(position))):
            ranks.append(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), rank.alias("rank"), (position - low).alias("frac")))
    # A few rows a group.
    wanted = materialize(binned.select(*group, "_bin", "_lo", "_hi", "_before", "_upto", F.explode(F.array(*ranks)).alias("r"))
                         .where((F.col("r.rank") >= F.col("_before")) & (F.col("r.rank") < F.col("_upto")))
                         .select(*group, "_bin", "_lo", "_hi", "_before", "r.name", "r.side", "r.rank", "r.frac"))

    bins = wanted.select(*group, "_bin", "_lo", "_hi").distinct()
    wide = F.col("_hi") > F.col("_lo")
    step = F.when(wide, F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * FINE)).otherwise(0).alias("_step")
    counted = materialize(rows.join(bins, [*group, "_bin"]).select(*group, "_bin", step, "_v")
                          .groupBy(*group, "_bin", "_step", "_v").agg(F.count(F.lit(1)).alias("_n")))
    steps = counted.groupBy(*group, "_bin", "_step").agg(F.sum("_n").alias("_m"))
    in_bin = Window.partitionBy(*group, "_bin").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_earlier", F.coalesce(F.sum("_m").over(in_bin), F.lit(0)))
    placed = (wanted.join(steps, [*group, "_bin"])
              .where((F.col("rank") - F.col("_before") >= F.col("_earlier")) & (F.col("rank") - F.col("_before") < F.col("_earlier") + F.col("_m"))))
    in_step = Window.partitionBy(*group, "_bin", "_step").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = (counted.join(placed.select(*group, "_bin", "_step").distinct(), [*group, "_bin", "_step"], "left_semi")
               .withColumn("_end", F.sum("_n").over(in_step)))
    offset = F.col("rank") - F.col("_before") - F.col("_earlier")
    hits = ordered.join(placed, [*group, "_bin", "_step"]).where((offset >= F.col("_end") - F.col("_n")) & (offset < F.col("_end")))

    def pick(name: str, side: str, what: str) -> Column:
        return F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col(what)))

    aggs = []
    for name in probs:
        low, high = pick(name, "lo", "_v"), pick(name, "hi", "_v")
        aggs.append((low + (high - low) * pick(name, "lo", "frac")).alias(name))
    out = hits.groupBy(*group).agg(*aggs)
    if also:
        out = _totals(hist, group, also).join(out, group, "left")
    return out if keys else out.drop("_all")
