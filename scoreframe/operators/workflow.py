"""Jobs around a ranking: source classification, link harvest, review rows, state upserts, final lists, node chips."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreframe.functions import scalar as S

# Decision statuses that put an entity on or off the final list, and the ones under way.
INCLUDED = ("interested", "considering", "applying", "applied", "interview", "accepted", "waitlisted")
EXCLUDED = ("not_applying", "rejected", "withdrawn")
ACTIVE = ("accepted", "interview", "applied", "applying")

# Outcomes of a source with their scores.
SOURCE_SCORES = {"exact_host": 1.0, "same_domain_named": 0.95, "same_domain": 0.9, "edu_named": 0.9, "edu": 0.7, "named": 0.55, "other": 0.25, "unsafe": 0.0}

#: A href attribute with its value, quoted or not.
HREF = r"""(?i)(?<![\w-])href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def classify_source(url: Column, official: Column, named: Column, unsafe: Column) -> Column:
    """struct (label, score, auto) of a url against an entity's official url; named: the text names the entity."""
    host, domain = S.url_host(url), S.url_domain(url)
    same, edu = domain == S.url_domain(official), F.coalesce(host, F.lit("")).endswith(".edu")
    label = (
        F.when(unsafe | host.isNull() | (host == ""), "unsafe").when(host == S.url_host(official), "exact_host").when(same & named, "same_domain_named")
        .when(same, "same_domain").when(edu & named, "edu_named").when(edu, "edu").when(named, "named").otherwise("other")
    )
    score = F.element_at(F.create_map(*[F.lit(x) for p in SOURCE_SCORES.items() for x in p]), label)
    return F.struct(label.alias("label"), score.alias("score"), (score >= 0.9).alias("auto"))


def harvest_links(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, href, n): the distinct link targets of each page with their counts; quoted either way or not at all."""
    forms = F.regexp_extract_all(html_col, F.lit(HREF), F.lit(1))
    target = F.regexp_replace(F.col("form"), r"^([\"'])(?s:(.*))\1$", "$2")
    found = pages.select(id_col, F.explode(forms).alias("form")).select(id_col, F.trim(target).alias("href"))
    return found.filter(F.col("href") != "").groupBy(id_col, "href").agg(F.count("*").alias("n"))


def probe_urls(seeds: DataFrame, url: str, suffixes: Sequence[str]) -> DataFrame:
    """(seed, probe): origin of each seed with each known path, without the seed; a list only, nothing is fetched."""
    made = F.explode(F.array(*[F.concat(S.url_origin(F.col(url)), F.lit(s)) for s in suffixes]))
    return seeds.select(F.col(url).alias("seed"), made.alias("probe")).filter("probe <> seed").distinct()


def review_queue(df: DataFrame, status: str, rules: dict[str, tuple[str, str]], default: tuple[str, str]) -> DataFrame:
    """Reason and recommended action by status."""
    pick = lambda i: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for s, r in rules.items() for x in (s, r[i])]), F.coalesce(F.col(status), F.lit(""))), F.lit(default[i]))
    return df.withColumn("reason", pick(0)).withColumn("action", pick(1))


def delta_report(current: DataFrame, new: DataFrame, key: str, a: str, b: str, large: tuple[float, float] = (2, 0.10)) -> DataFrame:
    """Differences of two metrics per key of ``new``: no_pair, large or aligned."""
    old = current.select(key, F.col(a).alias("_a"), F.col(b).alias("_b"))
    out = new.select(key, a, b).join(old, key, "left").withColumn("delta_a", F.col(a) - F.col("_a")).withColumn("delta_b", F.col(b) - F.col("_b"))
    status = F.when(F.col("delta_a").isNull() | F.col("delta_b").isNull(), "no_pair").when((F.abs("delta_a") > large[0]) | (F.abs("delta_b") > large[1]), "large").otherwise("aligned")
    return out.select(key, "delta_a", "delta_b", status.alias("status"))


def upsert_state(stored: DataFrame, export: DataFrame, keys: Sequence[str], fields: Sequence[str], pos: str, version: str, supported: int) -> DataFrame:
    """Export rows over stored rows: of several for a key the last by ``pos`` wins, rows without content and rows of
    another schema version are skipped, keys of ``stored`` without an export stay."""
    content = F.coalesce(*[S.missing(F.col(f).cast("string")) for f in fields]).isNotNull()
    last = export.filter((F.col(version) == supported) & content).groupBy(*keys).agg(F.max_by(F.struct(*fields), pos).alias("_e"))
    joined = stored.select(*keys, F.struct(*fields).alias("_s")).join(last, list(keys), "full").withColumn("_v", F.coalesce("_e", "_s"))
    return joined.select(*keys, *[F.col(f"_v.{f}").alias(f) for f in fields], F.when(F.col("_e").isNull(), "kept").when(F.col("_s").isNull(), "added").otherwise("replaced").alias("change"))


def final_list(entities: DataFrame, key: str, status: str, visibility: str, rank: str) -> DataFrame:
    """Visible entities with an including status and their priority."""
    s, r = F.lower(S.clean(F.col(status))), F.coalesce(F.col(rank), F.lit(9999))
    kept = entities.filter((F.lower(S.clean(F.col(visibility))) != "hidden") & s.isin(*INCLUDED) & ~s.isin(*EXCLUDED))
    priority = F.when(s.isin(*ACTIVE), F.when(r <= 40, "highest").otherwise("high")).when(r <= 25, "highest").when(r <= 40, "high").when(r <= 75, "medium").otherwise("low")
    return kept.withColumn("priority", priority).select(key, status, rank, "priority")


def node_status(missing: Sequence[tuple[str, Column]], core: Sequence[str]) -> Column:
    """struct (missing, readiness): names of the fields that are absent; provisional if a core one is."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in missing]))
    label = F.when(F.size(names) == 0, "ready").when(F.arrays_overlap(names, F.array(*map(F.lit, core))), "provisional").otherwise("partial")
    return F.struct(names.alias("missing"), label.alias("readiness"))


def why_bullets(bullets: Sequence[tuple[Column, Column]], most: int = 4) -> Column:
    """Texts of the tests that hold, in order, at most so many."""
    return F.slice(F.array_compact(F.array(*[F.when(test, text) for test, text in bullets])), 1, most)


def compare_table(df: DataFrame, key: str, ids: Sequence, fields: Sequence[str]) -> DataFrame:
    """(field, one column per chosen id): at most four."""
    if len(ids) > 4:
        raise ValueError("at most four entities are compared")
    long = df.filter(F.col(key).isin(*ids)).select(key, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([key], list(fields), "field", "value")
    return long.groupBy("field").pivot(key, list(ids)).agg(F.first("value"))


def workflow_step(research: Column, decision: Column, missing: Column) -> Column:
    """The next step of an entity from its research status, decision status and missing fields."""
    return F.when(decision.isin(*EXCLUDED), "closed").when(F.size(missing) > 0, F.concat(F.lit("find "), F.array_join(missing, ", "))).when(research.isin("researched", "ready_to_decide"), "decide").otherwise("research")


def workflow_rows(df: DataFrame, key: str, status: str, research: str, kept: Sequence[tuple[Column, Column]], cut: Sequence[tuple[Column, Column]], missing: Sequence[tuple[str, Column]]) -> DataFrame:
    """(key, status, why_kept, why_cut, missing, step): reasons in order, only for the side that the status is on."""
    s = F.lower(S.clean(F.col(status)))
    out = s.isin(*EXCLUDED)
    reasons = lambda tests: F.array_join(F.array_compact(F.array(*[F.when(t, x) for t, x in tests])), "; ")
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in missing]))
    return df.select(
        key, s.alias(status), F.when(out, "").otherwise(reasons(kept)).alias("why_kept"), F.when(out, reasons(cut)).otherwise("").alias("why_cut"),
        F.array_join(names, ",").alias("missing"), workflow_step(F.col(research), s, names).alias("step"),
    )


def status_counts(df: DataFrame, area: str, label: str) -> DataFrame:
    """(area, label, n, share): rows by label within each area, partially aggregated; null areas and labels count as 'unknown'."""
    df = df.withColumn(area, F.coalesce(F.col(area).cast("string"), F.lit("unknown")))
    n = df.groupBy(area, F.coalesce(F.col(label), F.lit("unknown")).alias(label)).agg(F.count("*").alias("n"))
    return n.join(n.groupBy(area).agg(F.sum("n").alias("_all")), area).withColumn("share", F.bround(F.col("n") / F.col("_all") * 100, 1)).drop("_all")


def export_state(df: DataFrame, owner: str, item: str, scope: str) -> DataFrame:
    """(owner, record): one JSON record of each owner with its distinct items in order; nulls are no items."""
    items = df.filter(F.col(item).isNotNull()).select(owner, item).distinct()
    return items.groupBy(owner).agg(F.array_sort(F.collect_list(item)).alias("ids")).select(owner, F.to_json(F.struct(F.lit(scope).alias("scope"), "ids")).alias("record"))


def assumptions(prefs: DataFrame, key: str, inputs: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(key, input, value, weight, note): one row per input (name, value column, weight column); the note says when a
    missing input or a zero weight turns it off."""
    rows = F.array(*[F.struct(F.lit(n).alias("input"), F.col(v).cast("double").alias("value"), F.coalesce(F.col(w).cast("double"), F.lit(0.0)).alias("weight")) for n, v, w in inputs])
    note = F.when(F.col("value").isNull(), "missing input").when(F.col("weight") == 0, "zero weight").otherwise("")
    return prefs.select(key, F.explode(rows).alias("_r")).select(key, "_r.*").withColumn("note", note)
