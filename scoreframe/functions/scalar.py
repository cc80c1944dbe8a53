"""Column functions: cleaning, parsing, banding, rendering, names, URLs. Built-in expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreframe.functions.fixed import FALSE_WORDS, STATES, TRUE_WORDS

Bands = Sequence[tuple[str, float | None, float | None]]
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def clean(c: Column) -> Column:
    """Null to empty, outer blanks trimmed."""
    return F.trim(F.coalesce(c, F.lit("")))


def missing(c: Column) -> Column:
    """Blank texts as null."""
    return F.nullif(clean(c), F.lit(""))


def parse_number(c: Column) -> Column:
    """Text with $ , % stripped as a double; null for blank, bad or non-finite text."""
    text = F.regexp_replace(F.trim(c), "[$,%]", "")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def positive(x: Column) -> Column:
    return F.when(x > 0, x)


def parse_positive(c: Column) -> Column:
    return positive(parse_number(c))


def is_truthy(c: Column) -> Column:
    return F.lower(clean(c)).isin(*TRUE_WORDS)


def is_falsey(c: Column) -> Column:
    return F.lower(clean(c)).isin(*FALSE_WORDS)


def flag(c: Column) -> Column:
    """True, false, or null for anything else."""
    return F.when(is_truthy(c), True).when(is_falsey(c), False)


def state_code(c: Column, strict: bool = True, table: dict[str, str] | None = None) -> Column:
    """Two-letter code from a code or a full name; not strict lets any two letters through. Empty if unknown."""
    names = table or STATES
    text, upper = F.lower(clean(c)), F.upper(clean(c))
    lookup = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    known = upper.isin(*sorted(set(names.values()))) if strict else upper.rlike("^[A-Z]{2}$")
    return F.when(known, upper).otherwise(F.coalesce(F.try_element_at(lookup, text), F.lit("")))


def clamp(x: Column, low: float = 1.0, high: float = 10.0) -> Column:
    """greatest and least skip nulls, so a null is kept apart."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def fit_score(a: Column, b: Column, scale: float) -> Column:
    return clamp(7 + (a - b) / scale)


def band_for(x: Column, bands: Bands, rounding: str = "none") -> Column:
    """Label of the first band that holds x. rounding: "integer" is int(x + 0.5), "cents" two decimals, ties to even."""
    v = {"none": x, "integer": (x + 0.5).cast("bigint").cast("double"), "cents": F.bround(x, 2)}[rounding]
    out = None
    for label, low, high in bands:
        test = (v >= low if low is not None else F.lit(True)) & (v <= high if high is not None else F.lit(True))
        out = F.when(test, label) if out is None else out.when(test, label)
    return F.when(x.isNull(), "").otherwise(out.otherwise(""))


def band_midpoint(c: Column, bands: Bands, open_step: float = 2.0, most: float | None = None) -> Column:
    """Middle of a band by label; an open lower end gives the upper bound, an open upper end the lower plus a step."""
    out = None
    for label, low, high in bands:
        mid = high if low is None else low + open_step if high is None else (low + high) / 2
        mid = min(mid, most) if most is not None and high is None else mid
        out = F.when(F.trim(c) == label, mid) if out is None else out.when(F.trim(c) == label, mid)
    return out


def label_by_threshold(x: Column, cuts: Sequence[tuple[float | None, str]], missing_label: str = "") -> Column:
    """cuts: (below, label) in rising order; the last has None."""
    out = F.when(x.isNull(), missing_label)
    for below, label in cuts[:-1]:
        out = out.when(x < below, label)
    return out.otherwise(cuts[-1][1])


def round_even(x: Column, digits: int) -> Column:
    """Ties to even, by the binary value, and -0.0 stays (bround goes by the shortest text of the double)."""
    scaled = x.cast("double") * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.rint(scaled) / 10.0**digits).otherwise(x.cast("double"))


def round_away(x: Column, digits: int) -> Column:
    """Ties away from zero, by the binary value (round goes by the shortest text of the double)."""
    scaled = x.cast("double") * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled, 0) / 10.0**digits).otherwise(x.cast("double"))


def fmt(x: Column, digits: int = 2) -> Column:
    """Fixed digits, ties to even; empty for null."""
    return F.when(x.isNotNull(), F.format_string(f"%.{digits}f", round_even(x, digits))).otherwise("")


def fmt_trimmed(x: Column, digits: int = 2) -> Column:
    text = fmt(x, digits)
    return F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def fmt_currency(x: Column) -> Column:
    return F.when(x > 0, F.concat(F.lit("$"), F.format_number(F.bround(x, 0).cast("bigint"), 0))).otherwise("")


def fmt_percent(x: Column) -> Column:
    return F.when(x.isNotNull(), F.concat(fmt_trimmed(x, 0), F.lit("%"))).otherwise("")


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[missing(c) for c in cols])


def first_positive(*cols: Column) -> Column:
    return F.coalesce(*[positive(c) for c in cols])


def component_label(c: Column) -> Column:
    return F.initcap(F.translate(F.regexp_replace(F.regexp_replace(c, "^(admissions_|attendance_)", ""), "_score", ""), "_", " "))


def value_type(c: Column) -> Column:
    return F.when(F.lower(F.trim(c)).rlike("^https?://"), "url").when(parse_number(c).isNotNull(), "number").otherwise("text")


def split_numbers(c: Column) -> Column:
    """Parts between ; and | as doubles, bad parts dropped."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[;|]"), parse_number), lambda x: x.isNotNull())


#: Latin letters with accents and their plain forms.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def normalize_name(c: Column, drop: Sequence[str] = ("the", "of", "at", "and", "for"), expand: Sequence[tuple[str, str]] = (("u\\.s\\.|\\bus\\b", " united states "),)) -> Column:
    """Lower case without accents, & as "and", expansions, runs of other signs as one blank, stop words dropped."""
    text = F.regexp_replace(F.lower(F.translate(clean(c), ACCENTED, PLAIN)), "&", " and ")
    for pattern, to in expand:
        text = F.regexp_replace(text, pattern, to)
    text = F.regexp_replace(text, "[^a-z0-9]+", " ")
    if drop:
        text = F.regexp_replace(text, rf"\b({'|'.join(drop)})\b", " ")
    return F.trim(F.regexp_replace(text, " +", " "))


def tokens(normalized: Column, stop: Sequence[str] = ()) -> Column:
    words = F.filter(F.split(normalized, " "), lambda w: w != "")
    return F.array_except(words, F.array(*[F.lit(s) for s in stop])) if stop else F.array_distinct(words)


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)


def dice(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)))).otherwise(0.0)


def containment(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))).otherwise(0.0)


def slugify(c: Column, fallback: str = "item") -> Column:
    text = F.regexp_replace(F.regexp_replace(F.lower(clean(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(text == "", fallback).otherwise(text)


def row_key(*cols: Column, length: int = 180) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws("_", *[clean(c) for c in cols])), "[^a-z0-9]+", "_"), "^_+|_+$", ""), 1, length)


def fold_text(text: Column) -> Column:
    """Dashes unified, white space folded."""
    return F.trim(F.regexp_replace(F.translate(text, "‐‑‒–—− ", "------ "), r"\s+", " "))


def xml_entities(text: Column) -> Column:
    """The entities that markup itself needs, decoded."""
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def compact_text(c: Column) -> Column:
    """XML entities decoded, dashes unified, white space folded."""
    return fold_text(xml_entities(F.coalesce(c, F.lit(""))))


def html_title(c: Column) -> Column:
    return compact_text(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1))


def html_to_text(c: Column) -> Column:
    """Visible text by patterns; parse_html in ``functions.text`` walks the markup instead."""
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>|<!--.*?-->", " ")
    return compact_text(F.regexp_replace(text, r"(?s)<[^>]*>", " "))


def html_to_lines(c: Column) -> Column:
    """Array of non-blank lines with all entities decoded; ends of blocks break lines."""
    from scoreframe.functions.text import unescape

    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?i)<br[^>]*>|</(p|div|li|tr|h[1-6]|title|td|ul|table)>", "\n")
    lines = F.transform(F.split(unescape(F.regexp_replace(text, r"<[^>]*>", " ")), "\n"), fold_text)
    return F.filter(lines, lambda x: x != "")


def url_host(c: Column) -> Column:
    """Lower-case host without user, port and www."""
    host = F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def url_domain(c: Column) -> Column:
    """Last two labels, or three under a second level like co.uk."""
    host = url_host(c)
    return F.when(host.rlike(r"\.(co|com|ac|edu|org)\.[a-z]{2}$"), F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 1)).when(host.rlike(r"\."), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).otherwise(host)


def url_origin(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)


def url_path(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_directory(c: Column) -> Column:
    """The url up to the last slash of its path."""
    return F.when(url_origin(c) != "", F.concat(url_origin(c), F.regexp_replace(F.when(url_path(c) == "", "/").otherwise(url_path(c)), "[^/]*$", "")))


def url_parent(c: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(url_path(c), "[^/]*$", ""), "[^/]+/$", "")
    return F.when(url_origin(c) != "", F.concat(url_origin(c), F.when(path == "", "/").otherwise(path)))


def url_join(base: Column, href: Column) -> Column:
    h = clean(href)
    return (
        F.when(h.rlike("^[a-zA-Z][a-zA-Z0-9+.\\-]*:"), h)
        .when(h.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), h))
        .when(h.startswith("/"), F.concat(url_origin(base), h))
        .when(h.startswith("#") | h.startswith("?"), F.concat(url_origin(base), url_path(base), h))
        .otherwise(F.concat(url_directory(base), h))
    )


def canonical_url(c: Column) -> Column:
    """https, lower-case host, no query, no fragment, no trailing slash."""
    return F.when(url_host(c) != "", F.concat(F.lit("https://"), url_host(c), F.regexp_replace(url_path(c), "/+$", ""))).otherwise("")


def decode_target(c: Column) -> Column:
    """A base64 link target as text, in one line or wrapped; null if it isn't one."""
    whole = F.regexp_replace(c, r"[\r\n]+", "")
    return F.when(F.length(whole) % 4 == 0, F.try_validate_utf8(F.try_to_binary(whole, F.lit("base64")).cast("string")))


def number_in(c: Column, low: float, high: float) -> Column:
    """The first number of the text that lies in the range."""
    found = F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1), lambda x: x.try_cast("double"))
    return F.get(F.filter(found, lambda x: x.between(low, high)), 0)


def labelled_number(c: Column, label: str) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), rf"(?i){label}\"?\s*[:=]?\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")


def parse_percent(c: Column) -> Column:
    """"45% (n=120)" as struct (value, n)."""
    return F.struct(
        F.nullif(F.regexp_extract(c, r"([0-9]+(?:\.[0-9]+)?)\s*%", 1), F.lit("")).try_cast("double").alias("value"),
        F.nullif(F.regexp_extract(c, r"(?i)n\s*=\s*([0-9]+)", 1), F.lit("")).try_cast("bigint").alias("n"),
    )


def parse_median_range(c: Column) -> Column:
    """"510 (498 - 520) n=33" as struct (median, low, high, n)."""
    part = lambda k: F.nullif(F.regexp_extract(c, r"^\s*([0-9.]+)\s*(?:\(\s*([0-9.]+)\s*-\s*([0-9.]+)\s*\))?\s*(?:n\s*=\s*([0-9]+))?", k), F.lit(""))
    return F.struct(part(1).try_cast("double").alias("median"), part(2).try_cast("double").alias("low"), part(3).try_cast("double").alias("high"), part(4).try_cast("bigint").alias("n"))


def parse_currency(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text.rlike(r"^\$?[0-9]{1,3}(,[0-9]{3})*(\.[0-9]+)?$|^\$?[0-9]+(\.[0-9]+)?$"), F.regexp_replace(text, "[$,]", "").try_cast("double"))


def add_optional(a: Column, b: Column) -> Column:
    """Null only if both are."""
    return F.when(a.isNotNull() | b.isNotNull(), F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def parse_location(c: Column) -> Column:
    """"City, ST" as struct (city, state)."""
    return F.struct(F.trim(F.regexp_extract(c, r"^\s*([^,]+),", 1)).alias("city"), F.regexp_extract(c, r",\s*([A-Z]{2})\b", 1).alias("state"))


def academic_year(c: Column) -> Column:
    """"2024-25" or "2024-2025" as "2024-2025"; empty if there is none."""
    a, b = F.regexp_extract(c, r"\b(20[0-9]{2})\s*[-/]\s*(?:20)?([0-9]{2})\b", 1), F.regexp_extract(c, r"\b(20[0-9]{2})\s*[-/]\s*(?:20)?([0-9]{2})\b", 2)
    return F.when(a != "", F.concat(a, F.lit("-20"), b)).otherwise("")


def search_text(*cols: Column) -> Column:
    return F.lower(F.concat_ws(" ", *cols))


def range_notes(rules: Sequence[tuple[Column, str]]) -> Column:
    """Notes of the tests that hold, joined by "; "."""
    return F.concat_ws("; ", *[F.when(test, note) for test, note in rules])


def infer_cell(c: Column) -> Column:
    """A cell as struct (kind, flag, whole, number, text): booleans, integers, other numbers, else text. Texts with a
    leading zero stay texts."""
    t = F.trim(c)
    zero = t.rlike("^0[0-9]+$")
    kind = F.when(F.upper(t).isin("TRUE", "FALSE"), "boolean").when(zero, "text").when(t.rlike("^-?[0-9]+$"), "integer").when(t.rlike(NUMBER), "number").otherwise("text")
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "boolean", F.upper(t) == "TRUE").alias("flag"),
        F.when(kind == "integer", t.try_cast("bigint")).alias("whole"),
        F.when(kind == "number", t.try_cast("double")).alias("number"),
        F.when(kind == "text", t).alias("text"),
    )
