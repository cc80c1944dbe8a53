"""Published statistics from text: spans of the pattern table, their contexts and years, the best pair, labelled
profiles, the program gate, and canonical rows of accepted extractions.

Patterns run in Arrow batches and give one row per value found; everything after that is column expressions, one window
per document and two groupings of the few rows found. A pattern has a bounded reach and needs a number of its kind, so it
runs only around such numbers, as far as it reaches, and only in texts that hold the letters it can't do without; years
are sought around numbers that may be one. A text is read once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from re import _parser  # the only part of Python that knows how much text a pattern can match

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreframe.functions import scalar as S
from scoreframe.functions import stat_patterns as P
from scoreframe.functions.fixed import GRADE_BANDS, RATE_CUTS, SCORE_BANDS
from scoreframe.sources.stages import spread

NAMES = tuple(p[0] for p in (*P.VALUE_PATTERNS, *P.RANGE_PATTERNS, *P.PAIR_PATTERNS))
FOLLOWED_YEARS = 2500  # characters over which a year holds
EVIDENCE = 700
_KINDS = ("mcat", "gpa", "science_gpa")
_FIELDS = "name string, form string, kind string, start long, low double, high double, whole string, around string, label string, follow string, precede string, metric string, year string"


def reach(pattern: str) -> int | None:
    """The longest match in characters where blanks stand alone and numbers have 20 digits at most, None without a bound."""
    longest = _parser.parse(pattern.replace(r"\s+", r"\s").replace(r"\s*", r"\s?").replace(r"\d+", r"\d{1,20}"), re.I).getwidth()[1]
    return longest if longest < 100_000 else None


def merged(places: Sequence[tuple[int, int]], before: int, after: int, end: int) -> list[tuple[int, int]]:
    """Intervals around ordered places, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in places:
        a, b = max(0, a - before), min(end, b + after)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def needed(pattern: str) -> str:
    """The longest run of letters and digits that every match holds, in lower case."""
    runs = [""]

    def walk(items) -> None:
        for op, value in items:
            if op is _parser.LITERAL and chr(value).isalnum() and value < 128:
                runs[-1] += chr(value).lower()
            elif op is _parser.SUBPATTERN:
                walk(value[3])
            else:
                runs.append("")
                if op is _parser.MAX_REPEAT and value[0] > 0:
                    walk(value[2])
                    runs.append("")

    walk(_parser.parse(pattern, re.I))
    return max(runs, key=len)


#: Signs beside A-Z and a-z that stand for one of them when case is ignored.
CASED = re.compile("[\u0130\u0131\u017f\u212a]")


class _Finder:
    """A pattern and where it is tried: around the numbers that a match must hold, as far as the pattern reaches. No match
    crosses the end of such an interval, and what stands before it still counts for word boundaries."""

    def __init__(self, pattern: str, number: str, windowed: bool):
        self.pattern, self.number, self.reach, self.needed = re.compile(pattern, re.I), number, reach(pattern) if windowed else None, needed(pattern)

    def hits(self, text: str, numbers: dict[str, list[tuple[int, int]]] | None, low: str | None = None) -> Iterator[re.Match]:
        """low: the text in lower case, if nothing else in it can stand for a letter."""
        if low is not None and self.needed not in low:
            return
        if numbers is None or self.reach is None:
            yield from self.pattern.finditer(text)
            return
        for a, b in merged(numbers[self.number], self.reach, self.reach + 2, len(text)):
            yield from self.pattern.finditer(text, a, b)


def stat_spans(docs: DataFrame, id_col: str, text_col: str, windowed: bool = True) -> DataFrame:
    """One row per value that a pattern finds, one named "year" per year of a class that a value may follow, and one named
    "any" with the latest year of a class in the text: place, numbers, the match, the text around it, and what stands right
    before and after the number. A text with runs of
    blanks or digits, which leave a pattern without a bound, is read whole, as are all without ``windowed``; the rows are
    the same, but for years before a value's reach."""
    kind = docs.schema[id_col].dataType.simpleString()
    of_kind = lambda k: "mcat" if k == "mcat" else "graded"
    values = [(n, k, _Finder(p, of_kind(k), windowed)) for n, k, p in P.VALUE_PATTERNS]
    ranges = [(n, k, _Finder(p, of_kind(k), windowed)) for n, k, p in P.RANGE_PATTERNS]
    pairs = [(n, _Finder(p, "graded" if "?P<gpa" in p else "mcat", windowed), wide) for n, p, _, _, _, wide in P.PAIR_PATTERNS]
    years = [re.compile(p, re.I) for p in P.YEAR_PATTERNS]
    year_reach = max(filter(None, map(reach, P.YEAR_PATTERNS)))
    header, header_reach = re.compile(P.TABLE_HEADER, re.I), reach(P.TABLE_HEADER)
    farthest = max(filter(None, (reach(p[-1] if len(p) == 3 else p[1]) for p in (*P.VALUE_PATTERNS, *P.RANGE_PATTERNS, *P.PAIR_PATTERNS))))
    # a word boundary before the number, looked for after it: a pattern that begins with a sign is sought faster
    number = {"mcat": re.compile(r"(?:4(?:7[2-9]|8\d|9\d)|5(?:0\d|1\d|2[0-8]))(?<!\w\d\d\d)"), "graded": re.compile(r"[2345]\.\d(?<!\w\d\.\d)")}
    digits, dates = re.compile(r"\d{21}"), re.compile(r"20\d\d")
    ascii_years = [re.compile(p, re.I | re.A) for p in P.YEAR_PATTERNS]  # blanks and digits as Spark's patterns have them
    gate = re.compile(r"m\s*cat|g\s*pa|science|bcpm", re.I)  # every pattern needs one of these

    def around(text: str, start: int, stop: int, width: int = 180) -> tuple[str, str, str]:
        return text[start:stop], text[max(0, start - width) : stop + width], text[max(0, start - 45) : stop].lower()

    def found(text: str, numbers: dict | None, low: str | None) -> Iterator[tuple]:
        for name, kind, finder in values:
            for m in finder.hits(text, numbers, low):
                group = next((g for g in ("after", "before", "after_short", "after_label", "after_ocr") if m.groupdict().get(g)), None)
                if group:
                    a, b = m.span(group)
                    yield name, "value", kind, m.start(), float(m[group]), float(m[group]), *around(text, *m.span()), text[b : b + 16], text[max(0, a - 16) : a], None, None
        for name, kind, finder in ranges:
            for m in finder.hits(text, numbers, low):
                least, most = sorted((float(m["low"]), float(m["high"])))
                yield name, "range", kind, m.start(), least, most, *around(text, *m.span()), "", "", None, None
        for name, finder, wide in pairs:
            if name == "table":
                places = [(0, len(text))] if numbers is None else merged(numbers["graded"], P.TABLE_REACH, header_reach + 2, len(text))
                heads = [h for a, b in places for h in header.finditer(text, a, b)]
                hits = ((h.start(), h.start() + m.end(), m) for h in heads for m in finder.pattern.finditer(text[h.start() : h.start() + P.TABLE_REACH]))
            else:
                hits = ((m.start(), m.end(), m) for m in finder.hits(text, numbers, low))
            for start, stop, m in hits:
                got = m.groupdict()
                for kind in _KINDS:
                    first = got.get(kind) or got.get(f"{kind}_low")
                    if first:
                        yield name, "pair", kind, start, float(first), float(got.get(f"{kind}_high") or first), *around(text, start, stop, wide), "", "", got.get("metric"), got.get("year")

    def years_in(text: str, patterns: Sequence[re.Pattern], a: int, b: int, whole: bool) -> Iterator[re.Match]:
        """Matches in text[a:b], sought around numbers that may be a year; all of it if blanks may be many."""
        places = [(a, b)] if whole else [(max(a, x), min(b, y)) for x, y in merged([m.span() for m in dates.finditer(text, a, b)], year_reach, year_reach + 2, len(text))]
        for x, y in places:
            for pattern in patterns:
                yield from pattern.finditer(text, x, y)

    def dated(text: str, rows: list[tuple], whole: bool) -> Iterator[tuple]:
        starts = sorted((r[3], r[3]) for r in rows)
        for a, b in [(0, len(text))] * bool(rows) if whole else merged(starts, FOLLOWED_YEARS + year_reach, year_reach + 2, len(text)):
            for m in years_in(text, years, a, b, whole):
                yield "year", "year", "", m.start(), 0.0, 0.0, "", "", "", "", "", None, m[1]

    def latest(text: str, whole: bool) -> Iterator[tuple]:
        last = max((m[1] for m in years_in(text, ascii_years, 0, len(text), whole)), default=None)
        if last is not None:
            yield "any", "any", "", 0, 0.0, 0.0, "", "", "", "", "", None, last

    def with_runs(text: str) -> bool:
        words = text.split()
        return sum(map(len, words)) + len(words) - 1 != len(text.strip()) or text[:2].isspace() or text[-2:].isspace() or (max(map(len, words), default=0) > 20 and bool(digits.search(text)))

    def read(text: str) -> list[tuple]:
        whole = not windowed or with_runs(text)
        numbers = None if whole else {k: [m.span() for m in p.finditer(text)] for k, p in number.items()}
        years_there = list(latest(text, whole))
        near = [(0, len(text))] if numbers is None else merged(sorted(n for ns in numbers.values() for n in ns), max(farthest, P.TABLE_REACH), farthest + 2, len(text))
        if not any(gate.search(text, a, b) for a, b in near):
            return years_there
        rows = list(found(text, numbers, None if whole or CASED.search(text) else text.lower()))
        return years_there + rows + list(dated(text, rows, whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *row) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if text for row in read(text)]
            cols = list(zip(*rows, strict=True)) or [()] * 14
            types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.float64(), *[pa.string()] * 7]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", *(f.split()[0] for f in _FIELDS.split(", "))])

    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, {_FIELDS}")


def _any(text: Column, words: Sequence[str]) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | text.contains(w)
    return test


def _last_place(text: Column, word: str) -> Column:
    """Place of the last occurrence from 0, -1 if there is none."""
    back = F.instr(F.reverse(text), word[::-1])
    return F.when(back > 0, F.length(text) - back - len(word) + 1).otherwise(-1)


def _last_word(text: Column, word: str) -> Column:
    """As above, for a word that no letter touches."""
    pattern = rf"(?s)^(.*)(?<![a-z]){re.escape(word)}(?![a-z])"
    return F.when(text.rlike(pattern), F.length(F.regexp_extract(text, pattern, 1))).otherwise(-1)


def context_metric(context: Column) -> Column:
    low = F.lower(context)
    return F.when(low.contains("range midpoint"), "range_midpoint").when(low.contains("median"), "median").when(low.contains("mean"), "mean").when(_any(low, ("average", "avg")), "average").otherwise("published")


def match_metric(match: Column, context: Column) -> Column:
    """The first word of an average in the match, else the context's."""
    low = F.lower(match)
    places = F.array(*[F.when(F.instr(low, w) > 0, F.struct(F.instr(low, w).alias("at"), F.lit(m).alias("metric"))) for w, m in (("median", "median"), ("mean", "mean"), ("average", "average"), ("avg", "average"))])
    return F.coalesce(F.array_min(F.array_compact(places))["metric"], context_metric(context))


def context_points(context: Column) -> tuple[Column, Column]:
    """(points, reason of rejection or null): words of requirements reject, unless the text denies a minimum or speaks of
    a threshold among academic statistics; words of profiles give a point each."""
    low = F.lower(context)
    averages = _any(low, ("average", "mean", "median"))
    denied = _any(low, ("no minimum", "do not have a minimum")) & averages
    reason = F.lit(None).cast("string")
    for w in reversed(P.MINIMUM_WORDS):
        excused = denied | (low.contains("academic stats") & averages) if w == "threshold" else denied
        reason = F.when(low.contains(w) & ~excused, f"minimum_requirement_context:{w}").otherwise(reason)
    points = sum((low.contains(w).cast("int") for w in P.PROFILE_WORDS), F.lit(0)) + 3 * _any(low, ("class composition", "new entrants")).cast("int") + low.contains("class of").cast("int")
    return F.when(reason.isNull(), points).otherwise(0), reason


def stat_candidates(spans: DataFrame, images: DataFrame) -> DataFrame:
    """(id, kind, value, metric, context, points, reason, year, corrected, nth, start) of the spans that count; a reason
    marks rejected ones. images: (id, is_image), sources whose 5.xx may be a misread 3.xx."""
    before = Window.partitionBy("id").orderBy("start", F.col("form") != "year", "year").rowsBetween(Window.unboundedPreceding, 0)
    anchor = F.last(F.when(F.col("form") == "year", F.struct("start", "year")), ignorenulls=True).over(before)
    # before the window, as filters after it would else work a context out anew for each of their words
    context = spans.withColumn("context", S.compact_text(F.col("around"))).drop("around")
    points, reason = context_points(F.col("context"))
    df = context.withColumn("_points", points).withColumn("_reason", reason).withColumn("anchor", anchor).filter("form <> 'year'")
    df = df.join(images, "id", "left").withColumn("is_image", F.coalesce("is_image", F.lit(False)))
    form, kind, low, high, label = (F.col(c) for c in ("form", "kind", "low", "high", "label"))
    graded = kind != "mcat"
    sound = F.when(graded, (low >= 0) & (high <= 4)).otherwise((low >= 472) & (high <= 528))
    df = df.withColumn("corrected", (form == "value") & graded & F.col("name").isin("gpa", "science_gpa") & F.col("is_image") & (low >= 5) & (low < 6) & F.lower("context").contains("gpa"))
    part_low = F.regexp_extract("precede", r"(\d+(?:\.\d+)?)\s*(?:-|–|—|to)\s*$", 1).try_cast("double")
    in_range = F.col("follow").rlike(r"^\s*(?:-|–|—|to)\s*\d") | F.coalesce(F.when(graded, part_low.between(0, 4) & low.between(0, 4)).otherwise(part_low.between(472, 528) & low.between(472, 528)), F.lit(False))
    percent = F.ltrim(F.substring("follow", 1, 3)).startswith("%")
    df = df.filter((sound | F.col("corrected")) & ~((form == "value") & (in_range | percent)))
    allowed = F.greatest(*[_last_place(label, w) for w in P.OVERALL_WORDS])
    barred = F.greatest(*[_last_place(label, w) for w in P.SCIENCE_WORDS], *[_last_word(label, w) for w in P.GRADUATE_WORDS])
    match = F.lower("whole")
    of_science = _any(match, P.SCIENCE_WORDS) | match.rlike(r"(?<!under)graduate\s+g\s*pa") | (barred > allowed)
    science = (kind == "gpa") & F.when(form == "value", of_science).otherwise(_any(label, P.SCIENCE_WORDS))
    df = df.withColumn("science", science).withColumn("allowed", allowed)
    extra = {n: b for n, _, _, b, _, _ in P.PAIR_PATTERNS}
    fixed = {n: f for n, _, _, _, f, _ in P.PAIR_PATTERNS if f}
    metrics = {n: m for n, _, m, _, _, _ in P.PAIR_PATTERNS if m and m != "row"}
    pick = lambda table: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("name"))
    fixed_points = pick(fixed)
    # pairs count only in a context that speaks for them, apart from those with points of their own
    paired = F.col("_reason").isNull() & ((F.col("_points") > 0) | (F.col("name") == "academic_table")) & ~((F.col("name") == "gpa_range_median") & F.col("science"))
    df = df.filter((form != "pair") | fixed_points.isNotNull() | paired)
    spread = (form == "range") | ((form == "pair") & (high != low))
    metric = (
        F.when(F.col("rejected_as") == "science_or_bcpm_gpa_context", "science_or_bcpm").when(spread, "range_midpoint").when(form == "value", match_metric(F.col("whole"), F.col("context")))
        .when(F.col("name") == "table", F.when(F.lower("metric") == "average", "mean").otherwise(F.lower("metric"))).otherwise(F.coalesce(pick(metrics), context_metric(F.col("context"))))
    )
    rejected = F.when((form != "pair") & F.col("science"), "science_or_bcpm_gpa_context").when(form != "pair", F.col("_reason"))
    scored = F.when(rejected.isNotNull(), 0).when(form == "value", F.col("_points") + F.when((kind == "gpa") & (F.col("allowed") >= 0), 2).otherwise(0)).when(form == "range", F.col("_points") + 2).otherwise(F.coalesce(fixed_points, F.col("_points") + pick(extra)))
    used = F.concat("context", F.lit(" Range midpoint used for "), F.upper("kind"), F.lit("."))
    held = F.col("anchor.start") >= F.col("start") - FOLLOWED_YEARS
    df = df.withColumn("rejected_as", rejected)
    return df.select(
        "id", "kind", F.bround(F.when(F.col("corrected"), low - 2).otherwise((low + high) / 2), 3).alias("value"), metric.alias("metric"),
        F.when(spread & F.col("rejected_as").isNull(), used).otherwise(F.col("context")).alias("context"), scored.alias("points"), F.col("rejected_as").alias("reason"),
        F.coalesce("year", F.when(held, F.col("anchor.year"))).cast("int").alias("year"), "corrected", F.when(form == "any", F.col("year")).cast("int").alias("any_year"),
        (F.array_position(F.array(*map(F.lit, NAMES)), F.col("name"))).alias("nth"), "start",
    )


def best_stats(candidates: DataFrame) -> DataFrame:
    """(id, mcat, gpa, science_gpa, year, reasons): the best values of the latest year that has both the first two, else the
    best of all; a science value of that year comes first. Best: points, median, year, value, pattern order."""
    order = F.struct("points", (F.col("metric") == "median").alias("m"), F.coalesce("year", F.lit(0)).alias("y"), "value", (-F.col("nth")).alias("n"), (-F.col("start")).alias("s"))
    good = F.col("reason").isNull() & (F.col("points") > 0)
    found = F.struct("value", "metric", "context", "corrected")
    kinds = [(k, good & (F.col("kind") == k)) for k in _KINDS]
    by_year = candidates.withColumn("order", order).withColumn("found", found).groupBy("id", "year").agg(
        *[F.max(F.when(test, F.struct("order", "found"))).alias(k) for k, test in kinds], F.collect_set("reason").alias("reasons"), F.max("any_year").alias("any_year")
    )
    shared = F.col("year").isNotNull() & F.col("mcat").isNotNull() & F.col("gpa").isNotNull()
    out = by_year.groupBy("id").agg(
        *[F.max(k).alias(f"any_{k}") for k in _KINDS],
        F.max(F.when(shared, F.struct("year", "mcat", "gpa", "science_gpa"))).alias("same"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("reasons")))).alias("reasons"), F.max("any_year").alias("any_year"),
    )
    pick = lambda k: F.coalesce(F.col(f"same.{k}.found"), F.col(f"any_{k}.found")).alias(k)
    return out.select("id", *[pick(k) for k in _KINDS], F.col("same.year").alias("year"), "reasons", "any_year")


def extract_stats(docs: DataFrame, id_col: str, text_col: str, url_col: str, score_col: str) -> DataFrame:
    """One row per document: status, review status, year, population, metric type, values, evidence and notes. The score
    is the source's: only an official source (0.9 and more) is accepted without review."""
    url = F.split(F.lower(S.clean(F.col(url_col))), r"\?")[0]
    is_image = F.lit(False)
    for end in P.IMAGE_SUFFIXES:
        is_image = is_image | url.endswith(end)
    docs, text = spread(docs), S.compact_text(F.col(text_col))
    heads = docs.select(F.col(id_col).alias("id"), F.col(score_col).cast("double").alias("official"))
    spans = stat_spans(docs.select(id_col, text.alias("text")), id_col, "text")
    best = best_stats(stat_candidates(spans, docs.select(F.col(id_col).alias("id"), is_image.alias("is_image")).filter("is_image")))
    df = heads.join(best, "id", "left")
    mcat, gpa, science = (F.col(k) for k in _KINDS)
    some, both = mcat.isNotNull() | gpa.isNotNull() | science.isNotNull(), mcat.isNotNull() & (gpa.isNotNull() | science.isNotNull())
    accepted = both & (F.coalesce("official", F.lit(0.0)) >= 0.9)
    reasons = F.array_join(F.coalesce("reasons", F.array().cast("array<string>")), "; ")
    status = F.when(accepted, "accepted").when(some, "needs_review_partial_stats").when(reasons != "", "rejected_minimum_requirement").otherwise("no_relevant_stats_found")
    evidence = S.compact_text(F.concat_ws(" ", mcat["context"], gpa["context"], science["context"]))
    said = F.lower(evidence)
    population = F.when(_any(said, ("accepted", "admitted")), "accepted students").when(_any(said, ("matriculant", "matriculated", "enrolled", "entering class")), "matriculated students").otherwise("official published school profile")
    metrics = F.array_compact(F.array(mcat["metric"], F.coalesce(gpa["metric"], science["metric"])))
    has = lambda m: F.array_contains(metrics, m)
    kind = F.when(has("range_midpoint"), "official_published_range_midpoint").when(has("median"), "official_published_median").when(has("mean") | has("average"), "official_published_mean").otherwise("official_published_value")
    ranged = F.array_contains(F.array_compact(F.array(*[F.col(k)["metric"] for k in _KINDS])), "range_midpoint")
    notes = (
        F.when(accepted, F.concat_ws(
            " ", F.lit("Both values stand in the context of a class profile on an official source."), F.when(F.col("year").isNotNull(), F.concat(F.lit("Latest shared year "), F.col("year"), F.lit("."))),
            F.when(ranged, "A value is the midpoint of a range."), F.when(gpa.isNull(), "Only a science average was found."), F.when(gpa["corrected"], "A misread 5.xx was corrected to 3.xx."),
        ))
        .when(some, "Only one of the two values was found, or the source is not official.").when(reasons != "", F.concat(F.lit("Only rejected contexts: "), reasons, F.lit("."))).otherwise("No values in the context of a class profile.")
    )
    return df.select(
        F.col("id").alias(id_col), status.alias("extraction_status"), F.when(accepted, "approved_official_extraction").otherwise("needs_review").alias("review_status"),
        F.coalesce("year", "any_year").alias("year"), population.alias("population"), kind.alias("metric_type"), F.bround(mcat["value"], 1).alias("mcat_value"), mcat["metric"].alias("mcat_metric"),
        F.bround(gpa["value"], 2).alias("gpa_value"), gpa["metric"].alias("gpa_metric"), F.bround(science["value"], 2).alias("science_gpa_value"), F.substring(evidence, 1, EVIDENCE).alias("evidence"), notes.alias("notes"),
    )


def extract_profile(docs: DataFrame, id_col: str, text_col: str, degree: Column, profile_url: Column, wanted: str = "DO") -> DataFrame:
    """Labelled values of a profile page, from the section that its header opens (the whole text without one). A row of
    another degree, or one whose url is no profile, is rejected; both values and their ranges are needed to accept."""
    text = S.compact_text(F.col(text_col))
    opened = F.regexp_extract(text, f"(?is)({P.PROFILE_HEADER}.*)", 1)
    section = F.substring(F.when(opened != "", opened).otherwise(text), 1, F.when(opened != "", P.PROFILE_SECTION).otherwise(1 << 30))
    value = lambda p: F.regexp_extract("section", f"(?i){p}", 1)
    df = docs.select(id_col, degree.alias("degree"), profile_url.alias("is_profile"), section.alias("section"))
    df = df.withColumn("mcat_mean", value(P.PROFILE_MCAT).try_cast("double")).withColumn("gpa_mean", value(P.PROFILE_GPA).try_cast("double"))
    both = F.col("mcat_mean").between(472, 528) & F.col("gpa_mean").between(0, 4)
    status = (
        F.when(F.upper(F.coalesce("degree", F.lit(""))) != wanted, "rejected_other_degree").when(~F.coalesce("is_profile", F.lit(False)), "rejected_invalid_profile_url").when(both, "accepted")
        .when(F.col("mcat_mean").isNotNull() | F.col("gpa_mean").isNotNull(), "needs_review_partial_stats").otherwise("no_relevant_stats_found")
    )
    return df.select(
        id_col, status.alias("extraction_status"), F.when(status == "accepted", "approved_extraction").otherwise("needs_review").alias("review_status"), F.bround("mcat_mean", 1).alias("mcat_mean"), F.bround("gpa_mean", 2).alias("gpa_mean"),
        value(P.PROFILE_OLDEST).alias("oldest_considered"), value(P.PROFILE_LATEST).alias("latest_accepted"), S.academic_year(F.col("section")).alias("academic_year"), F.substring("section", 1, EVIDENCE).alias("evidence"),
    )


def other_program(url: Column, title: Column) -> Column:
    """The url's path (its signs as blanks) or the title names another program."""
    path = F.regexp_replace(F.lower(F.coalesce(S.url_path(url), F.lit(""))), "[^a-z0-9]+", " ")
    return _any(F.concat_ws(" ", path, F.lower(S.clean(title))), P.OTHER_PROGRAMS)


def gate_extractions(extracted: DataFrame, degree: Column, url: Column, title: Column, wanted: str = "MD") -> DataFrame:
    """Accepted rows of another degree, and accepted or partial rows of another program, go back to review as rejected."""
    status = F.when((F.col("extraction_status") == "accepted") & (F.upper(S.clean(degree)) != wanted), "rejected_other_degree").otherwise(F.col("extraction_status"))
    status = F.when(status.isin("accepted", "needs_review_partial_stats") & other_program(url, title), "rejected_other_program").otherwise(status)
    out = extracted.withColumn("extraction_status", status)
    return out.withColumn("review_status", F.when(F.col("extraction_status") == "accepted", F.col("review_status")).otherwise("needs_review")).withColumn("confidence", F.when(F.col("extraction_status") == "accepted", "official_public_source_extracted").otherwise(""))


def reuse_extractions(candidates: DataFrame, prior: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows of prior results for these candidates, candidates that still have to be read), by url."""
    done = prior.join(candidates.select(key).distinct(), key, "left_semi")
    return done, candidates.join(prior.select(key).distinct(), key, "left_anti")


def fetch_decision(review_status: Column, source_type: Column, method: Column, official: Column, seeds: bool = False) -> Column:
    """struct (fetch, status): which candidates are read at once."""
    score = F.coalesce(official.cast("double"), F.lit(0.0))
    seed = review_status == "official_domain_seed_needs_stats_path"
    ready = (review_status == "accepted_for_fetch") & (source_type.isin("class_profile", "annual_report", "admissions_statistics", "pdf_report") | ((method == "assisted_search_official_url_seed") & (score >= 0.9)))
    ready = F.coalesce(ready | (F.lit(seeds) & seed & (score >= 0.9)), F.lit(False))
    status = F.when(ready, "").when(seed, "fetch_skipped_needs_stats_path").otherwise("fetch_skipped_needs_review")
    return F.struct(ready.alias("fetch"), status.alias("status"))


def promote(extracted: DataFrame, key: str, grid: DataFrame) -> DataFrame:
    """Canonical rows of accepted extractions: values in the median or the mean columns, bands, and the grid's rate with
    its band. grid: (score_band, grade_band, rate)."""
    rows = extracted.filter("extraction_status = 'accepted'")
    rows = rows.withColumn("score_band", S.band_for(F.floor(F.col("mcat_value") + 0.5).cast("double"), SCORE_BANDS)).withColumn("grade_band", S.band_for(F.bround("gpa_value", 2), GRADE_BANDS))
    median = F.col("metric_type").contains("median")
    out = rows.join(F.broadcast(grid.select("score_band", "grade_band", "rate").limit(110)), ["score_band", "grade_band"], "left")
    return out.select(
        key, "year", "population", "metric_type", F.lit(1).alias("source_count"), F.when(median, F.col("mcat_value")).alias("mcat_median"), F.when(median, F.col("gpa_value")).alias("gpa_median"),
        F.when(~median, F.col("mcat_value")).alias("mcat_mean"), F.when(~median, F.col("gpa_value")).alias("gpa_mean"), "score_band", "grade_band", "rate",
        S.label_by_threshold(F.col("rate"), RATE_CUTS).alias("rate_band"), F.lit(1).alias("quality_rank"), F.lit("high").alias("quality_band"),
    )
