"""Searches over an archive table of posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelex.functions.binding import let
from tidelex.functions.ordering import first_per_key, interval_join
from tidelex.functions.timefn import as_column
from tidelex.operators.filters import unseen

POST_TIME = "posted_at"


def searchable(df: DataFrame) -> Column:
    """Lower-cased title and body."""
    return F.lower(F.concat_ws(" ", "title", "selftext"))


def matched_terms(haystack: Column, terms: list[str]) -> Column:
    """The terms that occur in the text, in the order given; one pass per row, no join."""
    return let(haystack, lambda text: F.array_compact(F.array(*[
        F.when(text.contains(t.lower()), F.lit(t)) for t in terms])))


def first_matched_term(haystack: Column, terms: list[str]) -> Column:
    """The first term that occurs in the text; later terms are not looked for."""
    return let(haystack, lambda text: F.coalesce(*[F.when(text.contains(t.lower()), F.lit(t)) for t in terms]))


def in_range(df: DataFrame, start=None, end=None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(POST_TIME) >= as_column(start).cast("timestamp"))
    if end is not None:
        df = df.where(F.col(POST_TIME) <= as_column(end).cast("timestamp"))
    return df


def term_search(posts: DataFrame, terms: list[str], start=None, end=None,
                seen: DataFrame | None = None) -> DataFrame:
    """One row per post and term it holds, within a closed time range, minus seen ids.

    Terms are matched before seen ids are taken out, so a caller that does not
    ask for the texts does not have them shuffled.
    """
    posts = in_range(posts, start, end)
    hits = posts.withColumn("_terms", matched_terms(searchable(posts), terms)).where(F.size("_terms") > 0)
    if seen is not None:
        hits = unseen(hits, seen)
    return hits.withColumn("term", F.explode("_terms")).drop("_terms")


def date_search(posts: DataFrame, start=None, end=None, group: str | None = None,
                seen: DataFrame | None = None) -> DataFrame:
    """All posts of a group in a closed time range, minus seen ids."""
    posts = in_range(posts, start, end)
    if group is not None:
        posts = posts.where(F.col("subreddit") == group)
    return posts if seen is None else unseen(posts, seen)


def with_search_years(posts: DataFrame) -> DataFrame:
    """One row per year whose search returns the post.

    A year search keeps both ends, so a post made at midnight of Jan 1 is
    returned by two years.
    """
    year = F.year(POST_TIME)
    on_edge = F.col(POST_TIME) == F.date_trunc("year", F.col(POST_TIME))
    years = F.when(on_edge, F.array(year - 1, year)).otherwise(F.array(year))
    return posts.withColumn("search_year", F.explode(years))


def _without_text(df: DataFrame) -> DataFrame:
    """Hits are told apart by id, so their long texts need not be shuffled."""
    return df.drop("title", "selftext")


def term_sweep(posts: DataFrame, terms: list[str], first_year: int, last_year: int) -> DataFrame:
    """Year searches first, then one search per term; each id is kept by its first finder.

    Like the sweeps below, it returns the posts without their texts.
    """
    year = F.when(F.col(POST_TIME) == F.date_trunc("year", F.col(POST_TIME)),
                  F.year(POST_TIME) - 1).otherwise(F.year(POST_TIME))
    by_year = F.when((year < first_year) & (F.year(POST_TIME) == first_year), F.lit(first_year)).when(
        year.between(first_year, last_year), year)
    term = first_matched_term(searchable(posts), terms)
    found = posts.withColumn("found_by", F.coalesce(
        F.concat(F.lit("year "), by_year.cast("string")), F.concat(F.lit("term "), term)))
    found = found.where(F.col("found_by").isNotNull())
    return first_per_key(_without_text(found), ["id"], [F.col(POST_TIME), F.col("found_by")])


def window_search(posts: DataFrame, windows: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """Posts inside each window with the terms they hold; the earliest window keeps the id.

    The windows of one key may touch but not overlap.
    """
    # Terms are looked for before the join, so that only ids and terms are shuffled.
    found = _without_text(posts.withColumn("terms", matched_terms(searchable(posts), terms)))
    hits = interval_join(found, windows, keys, POST_TIME, "window_start", "window_end")
    return first_per_key(hits, ["id"], [F.col("window_start"), F.col("window_end")])


def window_sweep_with_fallback(primary: DataFrame, archive: DataFrame, windows: DataFrame,
                               terms: list[str], group: str = "subreddit",
                               min_fallback_days: int = 3) -> DataFrame:
    """Posts of each window; a window empty in ``primary`` is searched by term in ``archive``.

    ``windows`` holds (group, window_no, window_start, window_end). The first
    term that finds anything in a window ends its fallback search.
    """
    keys = [group]
    # Terms are looked for before the joins, so that no text is shuffled.
    ranks = let(searchable(archive), lambda text: F.array_compact(F.array(*[
        F.when(text.contains(t.lower()), F.lit(i)) for i, t in enumerate(terms)])))
    searched = _without_text(archive.withColumn("_ranks", ranks))
    direct = interval_join(_without_text(primary), windows, keys, POST_TIME, "window_start", "window_end")
    filled = direct.select(group, "window_no").distinct()
    wide = F.col("window_end") >= F.col("window_start") + F.make_dt_interval(F.lit(min_fallback_days))
    empty = windows.where(wide).join(filled, [group, "window_no"], "left_anti")
    candidates = interval_join(searched.where(F.size("_ranks") > 0), empty, keys, POST_TIME, "window_start", "window_end")
    hits = candidates.withColumn("_rank", F.explode("_ranks")).drop("_ranks")
    best = hits.groupBy(group, "window_no").agg(F.min("_rank").alias("_rank"))
    fallback = hits.join(best, [group, "window_no", "_rank"])
    term_names = F.array(*[F.lit(t) for t in terms])
    direct = direct.withColumn("found_by", F.lit("time"))
    fallback = fallback.withColumn("found_by", F.concat(
        F.lit("term "), F.get(term_names, F.col("_rank")))).drop("_rank")
    both = direct.unionByName(fallback.select(*direct.columns))
    return first_per_key(both, ["id"], [F.col("window_no")])
