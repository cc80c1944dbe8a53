"""Queries of statistics extraction, on documents to whose text a line of statistics of a known form is added."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreframe.functions.fixed import GRADE_BANDS, RATE_CUTS, SCORE_BANDS
from scoreframe.operators import extraction as E
from scoreframe.plans.registry import query, table

#: Between a document's own text and its line, so that no word of the text stands in a line's context.
FILL = "repeat('lorem ', 50)"
M, G = "CAST(500 + doc_id % 20 AS INT)", "CAST(50 + doc_id % 40 AS INT)"
LINES = (
    f"'Entering class of 2025. Matriculants had a median MCAT score of ' || {M} || ' and median GPA of 3.' || {G} || '.'",
    f"'Class profile for the class of 2024. Matriculants had MCAT score range ' || ({M} - 2) || '-' || ({M} + 4) || ' and cumulative GPA range 3.' || ({G} - 10) || '-3.' || ({G} + 10) || '.'",
    f"'Applicants must have a minimum MCAT score of ' || {M} || ' and a minimum GPA of 3.' || {G} || '.'",
    f"'Average MCAT score of ' || {M} || ' in the class.'",
    "''",
    f"'2023 entering class average MCAT was ' || {M} || ' and the average GPA was 3.' || {G}",
)
PAIRS = (
    f"'The average GPA and MCAT scores for matriculating students are 3.' || ({G} - 2) || '-3.' || ({G} + 2) || ' and ' || {M} || ', respectively.'",
    f"'Class profile by category GPA MCAT mean 3.' || {G} || ' ' || {M} || ' of all matriculants'",
    f"'Class Profiles 2025 2024 2023 Applied 4207 4320 4448 MCAT Score ' || {M} || ' 509 508 Average GPA 3.' || {G} || ' 3.83 3.80'",
    f"'Accepted students: 96 Profile Average GPA BCPM: 3.41 All other: 3.42 Total: 3.' || {G} || ' Average MCAT ' || {M}",
    f"'Profile Academics SCI AO GPA MCAT of matriculants median 3.45 3.46 3.' || {G} || ' ' || {M}",
    f"'Average GPA and MCAT for the entering class of 2026 was: 3.' || {G} || ' overall GPA and ' || {M} || ' MCAT'",
    f"'Matriculants profile GPA 3.20-4.00 3.' || {G} || ' MCAT 498-522 ' || {M}",
)


def _case(lines) -> str:
    return "CASE CAST(doc_id % {} AS INT) {} END".format(len(lines), " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(lines)))


def planted(spark, d, lines):
    text = F.expr(f"coalesce(text, '') || ' ' || {FILL} || {_case(lines)}")
    score = F.when(F.col("doc_id") % 10 == 9, 0.5).otherwise(1.0)
    return table(spark, d, "documents").select("doc_id", text.alias("text"), F.concat(F.lit("https://example.edu/class-profile/"), "doc_id").alias("url"), score.alias("score"))


COLUMNS = ("doc_id", "extraction_status", "review_status", "year", "population", "metric_type", "mcat_value", "gpa_value")
_M, _G = "CAST(500 + doc_id % 20 AS DOUBLE)", "round_even(3 + (50 + doc_id % 40) / 100.0, 2)"
D8 = f"""
WITH x AS (SELECT doc_id, doc_id % 6 AS k, doc_id % 10 = 9 AS low, CASE WHEN doc_id % 6 = 1 THEN {_M} + 1 WHEN doc_id % 6 IN (2, 4) THEN NULL ELSE {_M} END AS m, CASE WHEN doc_id % 6 IN (0, 1, 5) THEN {_G} END AS g FROM documents)
SELECT doc_id, CASE WHEN k IN (0, 1, 5) AND NOT low THEN 'accepted' WHEN k IN (0, 1, 3, 5) THEN 'needs_review_partial_stats' WHEN k = 2 THEN 'rejected_minimum_requirement' ELSE 'no_relevant_stats_found' END AS extraction_status,
  CASE WHEN k IN (0, 1, 5) AND NOT low THEN 'approved_official_extraction' ELSE 'needs_review' END AS review_status, CASE k WHEN 0 THEN 2025 WHEN 1 THEN 2024 WHEN 5 THEN 2023 END AS year,
  CASE WHEN k IN (0, 1, 5) THEN 'matriculated students' ELSE 'official published school profile' END AS population,
  CASE k WHEN 0 THEN 'official_published_median' WHEN 1 THEN 'official_published_range_midpoint' WHEN 3 THEN 'official_published_mean' WHEN 5 THEN 'official_published_mean' ELSE 'official_published_value' END AS metric_type,
  m AS mcat_value, g AS gpa_value FROM x"""


@query("d8_extract_stats", D8)
def d8(spark, d):
    return E.extract_stats(planted(spark, d, LINES), "doc_id", "text", "url", "score").select(*COLUMNS)


@query("d9_paired_finders", f"""
SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'needs_review_partial_stats' ELSE 'accepted' END AS extraction_status, CASE doc_id % 7 WHEN 2 THEN 2025 WHEN 5 THEN 2026 END AS year,
  CASE doc_id % 7 WHEN 0 THEN 'official_published_range_midpoint' WHEN 4 THEN 'official_published_median' WHEN 6 THEN 'official_published_median' ELSE 'official_published_mean' END AS metric_type,
  {_M} AS mcat_value, {_G} AS gpa_value, CASE WHEN doc_id % 7 = 4 THEN 3.45::DOUBLE WHEN doc_id % 7 = 3 THEN 3.41 END AS science_gpa_value FROM documents""")
def d9(spark, d):
    return E.extract_stats(planted(spark, d, PAIRS), "doc_id", "text", "url", "score").select("doc_id", "extraction_status", "year", "metric_type", "mcat_value", "gpa_value", "science_gpa_value")


PROFILE = f"""CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'MCAT/GPA Information Mean MCAT Score ' || {M} || ' Avg. Cum. Undergrad GPA Score 3.' || {G} || ' Oldest MCAT Considered 2022 Latest MCAT Score Accepted January 2025 2024-25'
  WHEN 1 THEN 'MCAT/GPA Information Mean MCAT Score: ' || {M} WHEN 2 THEN 'MCAT/GPA Information none' ELSE '' END"""


@query("d10_extract_profile", f"""
SELECT doc_id, CASE WHEN doc_id % 6 = 5 THEN 'rejected_other_degree' WHEN doc_id % 9 = 8 THEN 'rejected_invalid_profile_url' WHEN doc_id % 4 = 0 THEN 'accepted' WHEN doc_id % 4 = 1 THEN 'needs_review_partial_stats' ELSE 'no_relevant_stats_found' END AS extraction_status,
  CASE WHEN doc_id % 4 < 2 THEN {_M} END AS mcat_mean, CASE WHEN doc_id % 4 = 0 THEN {_G} END AS gpa_mean, CASE WHEN doc_id % 4 = 0 THEN '2022' ELSE '' END AS oldest_considered,
  CASE WHEN doc_id % 4 = 0 THEN 'January 2025' ELSE '' END AS latest_accepted FROM documents""")
def d10(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.expr(f"coalesce(text, '') || ' ' || {PROFILE}").alias("text"))
    degree, profile = F.when(F.col("doc_id") % 6 == 5, "MD").otherwise("do"), F.col("doc_id") % 9 != 8
    return E.extract_profile(docs, "doc_id", "text", degree, profile).select("doc_id", "extraction_status", "mcat_mean", "gpa_mean", "oldest_considered", "latest_accepted")


@query("d11_gate_extractions", f"""
WITH x AS ({D8}), p AS (SELECT doc_id FROM documents WHERE doc_id % 13 = 0)
SELECT doc_id, status AS extraction_status, CASE WHEN status = 'accepted' THEN 'official_public_source_extracted' ELSE '' END AS confidence, doc_id IN (SELECT doc_id FROM p) AS reused FROM (
  SELECT doc_id, CASE WHEN extraction_status = 'accepted' AND doc_id % 8 = 7 THEN 'rejected_other_degree' WHEN extraction_status IN ('accepted', 'needs_review_partial_stats') AND doc_id % 11 = 5 THEN 'rejected_other_program' ELSE extraction_status END AS status FROM x)""")
def d11(spark, d):
    """Results of before are reused for every thirteenth document; the others are read anew."""
    docs = planted(spark, d, LINES)
    prior = E.extract_stats(docs.filter("doc_id % 13 = 0"), "doc_id", "text", "url", "score")
    done, left = E.reuse_extractions(docs, prior, "doc_id")
    both = done.withColumn("reused", F.lit(True)).unionByName(E.extract_stats(left, "doc_id", "text", "url", "score").withColumn("reused", F.lit(False)))
    degree = F.when(F.col("doc_id") % 8 == 7, "DO").otherwise("MD")
    path = F.when(F.col("doc_id") % 11 == 5, F.lit("https://example.edu/nursing/admissions")).otherwise(F.lit("https://example.edu/class-profile"))
    return E.gate_extractions(both, degree, path, F.lit("Class profile")).select("doc_id", "extraction_status", "confidence", "reused")


@query("d11_fetch_decision", """
SELECT event_id, ready AS fetch, CASE WHEN ready THEN '' WHEN event_id % 4 = 0 THEN 'fetch_skipped_needs_stats_path' ELSE 'fetch_skipped_needs_review' END AS status FROM (
  SELECT event_id, event_id % 4 > 1 AND (event_id % 3 = 0 OR (event_id % 5 = 0 AND event_id % 7 <> 0)) AS ready FROM events)""")
def d11_fetch(spark, d):
    k = F.col("event_id")
    review = F.when(k % 4 == 0, "official_domain_seed_needs_stats_path").when(k % 4 == 1, "needs_review").otherwise("accepted_for_fetch")
    made = E.fetch_decision(review, F.when(k % 3 == 0, "class_profile").otherwise("unknown"), F.when(k % 5 == 0, "assisted_search_official_url_seed").otherwise("feed"), F.when(k % 7 == 0, 0.5).otherwise(1.0))
    return table(spark, d, "events").select("event_id", made.alias("m")).select("event_id", "m.*")


def _band(value: str, bands) -> str:
    tests = [f"WHEN {' AND '.join([f'{value} >= {lo}'] * (lo is not None) + [f'{value} <= {hi}'] * (hi is not None))} THEN '{label}'" for label, lo, hi in bands]
    return f"CASE {' '.join(tests)} ELSE '' END"


def _cut(value: str, cuts) -> str:
    return f"CASE WHEN {value} IS NULL THEN '' {' '.join(f'''WHEN {value} < {c} THEN '{t}' ''' for c, t in cuts[:-1])} ELSE '{cuts[-1][1]}' END"


GRID = [(s[0], g[0], float((7 * i + 11 * j) % 90)) for i, s in enumerate(SCORE_BANDS) for j, g in enumerate(GRADE_BANDS)]


@query("d18_promote", f"""
WITH x AS ({D8}), b AS (SELECT *, {_band("floor(mcat_value + 0.5)", SCORE_BANDS)} AS score_band, {_band("round_even(gpa_value, 2)", GRADE_BANDS)} AS grade_band FROM x WHERE extraction_status = 'accepted'),
  g(score_band, grade_band, rate) AS (VALUES {", ".join(f"('{a}', '{b}', {r}::DOUBLE)" for a, b, r in GRID)})
SELECT doc_id, year, CASE WHEN contains(metric_type, 'median') THEN mcat_value END AS mcat_median, CASE WHEN contains(metric_type, 'median') THEN gpa_value END AS gpa_median,
  CASE WHEN NOT contains(metric_type, 'median') THEN mcat_value END AS mcat_mean, CASE WHEN NOT contains(metric_type, 'median') THEN gpa_value END AS gpa_mean, score_band, grade_band, rate, {_cut("rate", RATE_CUTS)} AS rate_band
FROM b LEFT JOIN g USING (score_band, grade_band)""")
def d18(spark, d):
    grid = spark.createDataFrame(GRID, "score_band string, grade_band string, rate double")
    out = E.promote(E.extract_stats(planted(spark, d, LINES), "doc_id", "text", "url", "score"), "doc_id", grid)
    return out.select("doc_id", "year", "mcat_median", "gpa_median", "mcat_mean", "gpa_mean", "score_band", "grade_band", "rate", "rate_band")
