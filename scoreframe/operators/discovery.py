"""Sources to read: candidate rows with their statuses, links, sitemaps and profile cards of stored pages, known paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.functions import scalar as S
from scoreframe.operators import filters as P
from scoreframe.operators import workflow as W

# Paths under which class profiles are published, words of statistics pages and of admissions, and source types that are read at once.
KNOWN_PATHS = (
    "admissions/class-profile/", "admissions/entering-class-profile/", "admissions/entering-class-statistics/", "admissions/class-statistics/",
    "admissions/statistics/", "admissions/admissions-statistics/", "md-admissions/class-profile/", "md-admissions/entering-class-profile/",
    "md-program/admissions/class-profile/", "md-program/admissions/entering-class-profile/", "education/md/admissions/class-profile/",
    "education/md/admissions/entering-class-profile/", "education/md-program/admissions/class-profile/", "education/md-program/admissions/entering-class-profile/",
    "medical-student-admissions/md-admissions/class-profile/", "medical-student-admissions/class-profile/", "academics/medicine/class-profile/",
    "academics/md-program/admissions/class-profile/", "class-profile/", "entering-class-profile/", "entering-class-statistics/", "class-statistics/",
    "admissions-profile/", "facts-and-figures/", "about/facts-and-figures/", "fast-facts/", "facts/",
)
STATS_WORDS = (
    "class-profile", "class_profile", "classprofile", "student-profile", "student_profile", "entering-class", "entering_class", "incoming-class", "incoming_class",
    "matriculant", "matriculants", "facts-and-figures", "facts_figures", "facts", "figures", "fact-sheet", "fact_sheet", "admissions-statistics", "admissions_statistics",
    "class-statistics", "class_statistics", "by-the-numbers", "annual-report", "annual_report", "fact-book", "factbook",
    "class profile", "class of", "student profile", "entering class", "incoming class", "facts and figures", "admissions statistics", "class statistics", "by the numbers",
    "annual report", "fact book", "fact sheet",
)
ADMISSIONS_WORDS = ("admission", "admissions", "apply", "application", "requirements", "md-program", "doctor-of-medicine", "medicine")
FETCH_READY = ("class_profile", "annual_report", "admissions_statistics", "pdf_report")

_ANCHOR = r"(?is)<a\b[^>]*>.*?(?:</a\s*>|(?=<a\b)|\z)"
_HREF = r"""(?is)^<a\b[^>]*?(?<![\w-])href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _about(url: Column, *texts: Column) -> Column:
    """Path, query and fragment of a url with their signs as blanks, then the texts; lower case."""
    path = F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(.*)$", 1), r"[%_\-/?#]+", " ")
    return F.lower(F.concat_ws(" ", path, *[S.clean(t) for t in texts]))


def _any(text: Column, words: Sequence[str]) -> Column:
    return P.classify_topic(text, [("yes", words)], "") == "yes"


def source_type(url: Column, *texts: Column) -> Column:
    """pdf_report, annual_report, admissions_statistics, class_profile, admissions_page or unknown."""
    said = _about(url, *texts)
    kind = F.when(_any(said, ("annual report", "annual-report", "fact book", "factbook")), "annual_report").when(said.contains("statistic"), "admissions_statistics").otherwise("class_profile")
    pdf = F.split(F.lower(S.clean(url)), r"\?")[0].endswith(".pdf")
    return F.when(pdf, "pdf_report").when(_any(said, STATS_WORDS), kind).when(_any(said, ADMISSIONS_WORDS), "admissions_page").otherwise("unknown")


def candidates(found: DataFrame, url: Column, title: Column, official: Column, named: Column, method: Column, unsafe: Column) -> DataFrame:
    """found with source type, host, outcome and score of the source, review and fetch status, and method. An official
    source is read at once if it looks like statistics; else it waits for a path; others wait for review. Without an
    official url the candidate's own origin stands in for it."""
    result = W.classify_source(url, F.coalesce(S.missing(official), S.url_origin(url)), named, unsafe)
    kind = source_type(url, title)
    df = found.withColumn("source_type", kind).withColumn("source_host", S.url_host(url)).withColumn("_c", result)
    ready = F.col("source_type").isin(*FETCH_READY)
    review = F.when(F.col("_c.auto") & ready, "accepted_for_fetch").when(F.col("_c.auto"), "official_domain_seed_needs_stats_path").otherwise("needs_review")
    df = df.withColumn("official_status", F.col("_c.label")).withColumn("official_score", F.col("_c.score")).withColumn("review_status", review).drop("_c")
    return df.withColumn("fetch_status", F.when(F.col("review_status") == "official_domain_seed_needs_stats_path", "not_applicable").otherwise("not_fetched")).withColumn("method", method)


def page_links(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, seed, url, text, nth): every link of a page with its text, joined to the page's url, the first of its url."""
    tags = F.posexplode(F.regexp_extract_all(html_col, F.lit(_ANCHOR), F.lit(0)))
    rows = pages.select(id_col, F.col(url_col).alias("seed"), tags.alias("nth", "tag"))
    href = F.trim(S.xml_entities(F.regexp_replace(F.regexp_extract("tag", _HREF, 1), r"^([\"'])(?s:(.*))\1$", "$2")))
    rows = rows.withColumn("href", href).filter("href <> ''")
    text = S.compact_text(F.regexp_replace("tag", r"(?s)<[^>]*>", " "))
    rows = rows.select(id_col, "seed", S.url_join(F.col("seed"), F.col("href")).alias("url"), text.alias("text"), "nth")
    return rows.groupBy(id_col, "seed", "url").agg(F.min_by("text", "nth").alias("text"), F.min("nth").alias("nth"))


def on_topic(links: DataFrame, most: int) -> DataFrame:
    """Links to the seed's own domain that look like statistics, the first ``most`` of each seed by their place."""
    same = S.url_domain(F.col("url")) == S.url_domain(F.col("seed"))
    said = _about(F.col("url"), F.col("text"))
    # a seed is one page: its links are few
    nth = F.row_number().over(Window.partitionBy("seed").orderBy("nth", "url"))
    return links.filter(same & _any(said, STATS_WORDS)).withColumn("_n", nth).filter(F.col("_n") <= most).drop("_n")


def harvest_sitemaps(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, url): the distinct loc elements of sitemaps, with any prefix, CDATA or none, entities decoded."""
    locs = F.regexp_extract_all(text_col, F.lit(r"(?is)<(?:[\w-]+:)?loc\b[^>]*>(.*?)</"), F.lit(1))
    url = F.trim(S.xml_entities(F.regexp_replace(F.col("loc"), r"(?is)^\s*<!\[CDATA\[(.*?)\]\]>?\s*$", "$1")))
    return docs.select(id_col, F.explode(locs).alias("loc")).select(id_col, url.alias("url")).filter("url <> ''").distinct()


def harvest_cards(pages: DataFrame, id_col: str, url_col: str, html_col: str, host: str, prefix: str) -> DataFrame:
    """(id, url, title, city, state): profile cards of a listing. A card is an element with a base64 data-target and a
    heading and location within; profiles that are only linked or named have a title made from their slug."""
    card = r"""(?is)<[a-z0-9]+\b[^>]*\bdata-(?:srch-)?target\s*=\s*["']([A-Za-z0-9+/=_-]+)["'][^>]*>(.*?)(?=<[a-z0-9]+\b[^>]*\bdata-(?:srch-)?target\s*=|\z)"""
    whole = F.regexp_extract_all(html_col, F.lit(card), F.lit(0))
    cells = pages.select(id_col, F.col(url_col).alias("base"), F.explode(whole).alias("card"))
    body, target = F.regexp_extract("card", card, 2), F.regexp_extract("card", card, 1)
    heading = S.compact_text(F.regexp_replace(F.regexp_extract(body, r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]\s*>", 1), r"(?s)<[^>]*>", " "))
    place = S.compact_text(F.regexp_replace(F.regexp_extract(body, r"""(?is)<[a-z0-9]+\b[^>]*class\s*=\s*["'][^"']*\blocation\b[^"']*["'][^>]*>(.*?)</""", 1), r"(?s)<[^>]*>", " "))
    where = S.parse_location(place)
    cards = cells.select(id_col, S.canonical_url(S.url_join(F.col("base"), F.coalesce(S.decode_target(target), F.lit("")))).alias("url"), heading.alias("title"), where["city"].alias("city"), where["state"].alias("state"), F.lit(0).alias("rank"))
    linked = page_links(pages, id_col, url_col, html_col).select(id_col, S.canonical_url(F.col("url")).alias("url"), F.lit("").alias("title"), F.lit(None).cast("string").alias("city"), F.lit(None).cast("string").alias("state"), F.lit(1).alias("rank"))
    profile = (S.url_host(F.col("url")) == host) & F.coalesce(S.url_path(F.col("url")), F.lit("")).rlike(f"^{prefix}[^/]+")
    best = cards.unionByName(linked).filter(profile).groupBy(id_col, "url").agg(F.min_by(F.struct("title", "city", "state"), "rank").alias("c"))
    slug = F.initcap(F.regexp_replace(F.regexp_extract("url", r"([^/]+)/*$", 1), "[-_]+", " "))
    return best.select(id_col, "url", F.coalesce(S.missing(F.col("c.title")), slug).alias("title"), F.coalesce("c.city", F.lit("")).alias("city"), F.coalesce("c.state", F.lit("")).alias("state"))


def known_path_probes(seeds: DataFrame, url: str, paths: Sequence[str] = KNOWN_PATHS, most: int = 0) -> DataFrame:
    """(seed, probe, nth): each path under the seed's origin, its folder and the folder above, each base once, without the
    seed itself; a probe once, at its first place; at most so many of each seed, all for 0. A list only, nothing is read."""
    u = F.col("seed")
    bases = F.array_distinct(F.filter(F.array(F.concat(S.url_origin(u), F.lit("/")), S.url_directory(u), S.url_parent(u)), lambda b: b.isNotNull() & (b != "")))
    made = F.array_distinct(F.flatten(F.transform(bases, lambda b: F.array(*[F.concat(b, F.lit(p)) for p in paths]))))
    others = F.filter(made, lambda p: p != F.trim(u))
    listed = F.slice(others, 1, most) if most else others
    return seeds.select(F.col(url).alias("seed")).distinct().select("seed", F.posexplode(listed).alias("nth", "probe"))
