"""Filters and predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions import scalar as S


def active_entities(df: DataFrame, ident: str, active: str, excluded: str, kind: tuple[str, str] | None = None) -> DataFrame:
    """Id present, active flag blank or true, not excluded by hand, of a kind if one is asked for."""
    keep = S.missing(F.col(ident).cast("string")).isNotNull() & (S.missing(F.col(active)).isNull() | S.is_truthy(F.col(active))) & ~S.is_truthy(F.col(excluded))
    return df.filter(keep & (F.col(kind[0]) == kind[1])) if kind else df.filter(keep)


def default_or_all(df: DataFrame, flag: str) -> DataFrame:
    """Rows flagged default if there are any, else all. The test is one aggregate row joined back."""
    any_ = df.agg(F.coalesce(F.bool_or(S.is_truthy(F.col(flag))), F.lit(False)).alias("_any"))
    return df.join(F.broadcast(any_), S.is_truthy(F.col(flag)) == F.col("_any"), "left_semi")


def accepted_only(df: DataFrame, status: str, accepted: Sequence[str], review: str | None = None, cleared: Sequence[str] = (), score: str | None = None, least: float = 0.9, any_of: Sequence[str] = ()) -> DataFrame:
    """Status accepted, review status cleared, confidence high enough, one of the values present."""
    keep = F.col(status).isin(*accepted)
    if review:
        keep &= F.col(review).isin(*cleared)
    if score:
        keep &= F.col(score) >= least
    if any_of:
        keep &= F.coalesce(*[F.col(c).cast("string") for c in any_of]).isNotNull()
    return df.filter(keep)


def filter_entities(df: DataFrame, prefs: dict) -> DataFrame:
    """Composed user filter: kind, region, required amount, excluded states and cities, ownership if the table labels
    any, text. A missing preference doesn't filter."""
    if prefs.get("kind"):
        df = df.filter(F.col("kind") == prefs["kind"])
    if prefs.get("region"):
        df = df.filter(F.col("region") == prefs["region"])
    if prefs.get("with_cost"):
        df = df.filter(F.col("cost") > 0)
    if prefs.get("excluded_states"):
        df = df.filter(~F.coalesce(F.col("state").isin(*prefs["excluded_states"]), F.lit(False)))
    if prefs.get("excluded_cities"):
        df = df.filter(~F.coalesce(F.lower("city").isin(*[c.lower() for c in prefs["excluded_cities"]]), F.lit(False)))
    if prefs.get("ownership"):
        labelled = df.agg(F.coalesce(F.bool_or(S.missing(F.col("ownership")).isNotNull()), F.lit(False)).alias("_l"))
        df = df.join(F.broadcast(labelled), (F.col("_l") == False) | (F.col("ownership") == prefs["ownership"]), "left_semi")  # noqa: E712
    if prefs.get("query"):
        df = df.filter(F.contains(S.search_text(F.col("name"), F.col("city"), F.col("state")), F.lit(prefs["query"].lower())))
    return df


def facet_filter(df: DataFrame, facets: dict[str, Sequence]) -> DataFrame:
    for col, values in facets.items():
        if values:
            df = df.filter(F.col(col).isin(*values))
    return df


def facet_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(facet, value, n) of every facet, by one pass."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in cols])).alias("c"))
    return cells.filter("c.value IS NOT NULL").groupBy("c.facet", "c.value").agg(F.count("*").alias("n"))


def worklist_filter(df: DataFrame, visibility: str | None = None, statuses: Sequence[str] = (), max_rank: int | None = None, complete: bool | None = None, required: Sequence[str] = ()) -> DataFrame:
    if visibility:
        df = df.filter(F.coalesce(S.missing(F.col("visibility")), F.lit("visible")) == visibility)
    if statuses:
        df = df.filter(F.col("status").isin(*statuses))
    if max_rank is not None:
        df = df.filter(F.col("rank") <= max_rank)
    if complete is not None and required:
        full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])
        df = df.filter(full if complete else ~full)
    return df


def screen_fit(metrics: Sequence[tuple[Column, Column, Column]]) -> Column:
    """Each metric (value, low, high) lies below, within or above its range: any below and any above is mixed; any below
    (the user is under the range) is reach; any above is likely; all within is near; nothing comparable is unknown."""
    sides = F.filter(F.array(*[F.when(v < lo, "below").when(v > hi, "above").when(v.isNotNull() & lo.isNotNull() & hi.isNotNull(), "within") for v, lo, hi in metrics]), lambda s: s.isNotNull())
    below, above = F.exists(sides, lambda s: s == "below"), F.exists(sides, lambda s: s == "above")
    return F.when(F.size(sides) == 0, "unknown").when(below & above, "mixed").when(below, "below").when(above, "above").otherwise("within")


def score_fit_label(a: Column, b: Column) -> Column:
    """Mean and minimum of two components; one present component has cuts of its own."""
    mean, low, one = (a + b) / 2, F.least(a, b), F.coalesce(a, b)
    both = F.when((mean >= 8.5) & (low >= 7.5), "strong").when((mean >= 7.2) & (low >= 6), "good").when(mean >= 5.8, "possible").when(mean >= 4.2, "stretch").otherwise("unlikely")
    return F.when(a.isNotNull() & b.isNotNull(), both).when(one.isNull(), "unknown").when(one >= 6.5, "good").when(one >= 4.2, "stretch").otherwise("unlikely")


def classify_topic(text: Column, topics: Sequence[tuple[str, Sequence[str]]], default: str = "other") -> Column:
    """The first topic one of whose terms occurs in the text."""
    out = None
    for topic, terms in topics:
        test = reduce(lambda x, y: x | y, [F.contains(F.lower(text), F.lit(t)) for t in terms])
        out = F.when(test, topic) if out is None else out.when(test, topic)
    return out.otherwise(default)


def is_unsafe_url(c: Column, blocked: Sequence[str]) -> Column:
    """No scheme or host, a blocked host fragment, or a path that begins with /search."""
    host = S.url_host(c)
    bad = reduce(lambda a, b: a | b, [F.contains(host, F.lit(x)) for x in blocked]) if blocked else F.lit(False)
    return (host == "") | bad | S.url_path(c).startswith("/search")


def drop_placeholders(df: DataFrame, col: str, placeholders: Sequence[str], amounts: Sequence[str] = ()) -> DataFrame:
    """Rows with a real value, and a positive amount where amounts are named."""
    keep = S.missing(F.col(col)).isNotNull() & ~F.lower(F.trim(F.col(col))).isin(*placeholders)
    if amounts:
        keep &= F.greatest(*[F.coalesce(F.col(a).cast("double"), F.lit(0.0)) for a in amounts], F.lit(0.0)) > 0
    return df.filter(keep)
