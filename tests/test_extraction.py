"""Statistics extraction on sentences of every form, profile pages, the program gate, reuse and promotion."""

import pytest
from pyspark.sql import functions as F

from scoreframe.functions import scalar as S
from scoreframe.functions import stat_patterns as P
from scoreframe.operators import extraction as E

CASES = {
    # text: (status, mcat, gpa, science gpa, metric type, year)
    "Profile of the entering class of 2027: matriculants have a median MCAT score of 511 and a median GPA of 3.77.": ("accepted", 511, 3.77, None, "median", 2027),
    "Entering Class of 2021 with 99 matriculated: Average GPA 3.51 Average MCAT 504. Entering Class of 2023 with 97 matriculated: Average GPA 3.62 Average MCAT 507.": ("accepted", 507, 3.62, None, "mean", 2023),
    "We do not have a minimum GPA or MCAT score, but average GPA and MCAT scores for accepted students are 3.6-3.66 and 508, respectively.": ("accepted", 508, 3.63, None, "range_midpoint", None),
    "Class profile for the class of 2030. Matriculants had MCAT score range 506-512 and cumulative GPA range 3.60-3.80.": ("accepted", 509, 3.7, None, "range_midpoint", 2030),
    "Class of 2028 Class Profile 512 Median MCAT 3.84 Mean GPA 3.80 Mean BCPM GPA": ("accepted", 512, 3.84, 3.8, "median", 2028),
    "Class of 2027 profile. An average undergraduate GPA of 3.72. An average MCAT 2015 score of 511.14.": ("accepted", 511.1, 3.72, None, "mean", 2027),
    "Class of 2026 Average MCAT BBFL 129.11 CARS 127.52 CPBS 129.02 PSBB 129.40 Total 515.2 Average GPA 3.8": ("accepted", 515.2, 3.8, None, "mean", 2026),
    "Entering Class of 2024. GPA and MCAT of matriculated students. Category GPA MCAT Mean 3.71 513 Median 3.79 514": ("accepted", 514, 3.79, None, "median", 2024),
    "Class Profiles of the classes entering over three years. 2024 2023 2022 Applied 4001 4100 4200 MCAT Score 510.5 510 509.5 Average GPA 3.81 3.80 3.79": ("accepted", 510.5, 3.81, None, "mean", 2024),
    "Accepted students: 88. Profile. Average GPA BCPM: 3.70 All other: 3.85 Total: 3.78 Average MCAT 511": ("accepted", 511, 3.78, 3.7, "mean", None),
    "Class of 2028 Profile Mean MCAT 513 Median MCAT 516 Mean GPA (total) 3.75 Median GPA (total) 3.81": ("accepted", 516, 3.81, None, "median", 2028),
    "Applicants need at least the average MCAT/GPA threshold of last year. The 2024 entering class average MCAT composite was 506 and the average cumulative GPA was 3.71.": ("accepted", 506, 3.71, None, "mean", 2024),
    "Facts of the 2024 Entering Class at a Glance 3.35-4.00 GPA Range 511-525 MCAT Range": ("accepted", 518, 3.68, None, "range_midpoint", 2024),
    "Class of 2027 has 101 entrants 517 median MCAT 3.88 median undergrad GPA": ("accepted", 517, 3.88, None, "median", 2027),
    "Profile Academics SCI AO GPA MCAT CARS CPBS Median 3.91 3.95 3.93 519 130 131 Mean 3.90 3.94 3.92 519.1 130 130.2": ("accepted", 519, 3.93, 3.91, "median", None),
    "Entering class of 2022 Median total GPA: 3.85. Average total MCAT: 88 percentile, 513 score.": ("accepted", 513, 3.85, None, "median", 2022),
    "Class of 2024 matriculants 120 Average cumulative GPA, four-point scale 3.69 Average MCAT15 composite 509": ("accepted", 509, 3.69, None, "mean", 2024),
    "Applicants are required to have MCAT score range 500-528 and cumulative GPA range 3.10-4.00.": ("rejected_minimum_requirement", None, None, None, "value", None),
    "Class Profile Average BCPM GPA: 3.74 Average MCAT Total: 510.": ("accepted", 510, None, 3.74, "mean", None),
    "Academic Stats 3.61 (Range: 2.70-4.00) Mean Overall GPA 3.52 (Range: 2.30-4.00) Mean BCPM GPA 505.5 (Range: 495-518) Mean MCAT; a threshold is met by few.": ("accepted", 505.5, 3.61, 3.52, "mean", None),
    "Class profile: average GPA 3.5% and MCAT in the 90th percentile of all.": ("no_relevant_stats_found", None, None, None, "value", None),
    "The college has 3,000 students.": ("no_relevant_stats_found", None, None, None, "value", None),
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(i, t, "https://example.edu/profile", 1.0) for i, t in enumerate(CASES)], "id long, text string, url string, score double")
    return {r["id"]: r for r in E.extract_stats(docs, "id", "text", "url", "score").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_sentence(found, i):
    status, mcat, gpa, science, kind, year = list(CASES.values())[i]
    r = found[i]
    assert (r["extraction_status"], r["mcat_value"], r["gpa_value"], r["science_gpa_value"], r["metric_type"].removeprefix("official_published_"), r["year"]) == (status, mcat, gpa, science, kind, year)
    assert (r["review_status"] == "approved_official_extraction") == (status == "accepted") and (len(r["evidence"]) > 0) == (mcat is not None)


def test_source_decides_acceptance_and_reading_of_images(spark):
    text = "Class profile: entering class with a median MCAT of 510 and a median GPA of 5.71."
    docs = spark.createDataFrame([(1, text, "https://e.edu/p.PNG?x", 1.0), (2, text, "https://e.edu/p.html", 1.0), (3, text.replace("5.71", "3.71"), "https://e.edu/p", 0.7), (4, None, None, None)], "id long, text string, url string, score double")
    got = {r["id"]: (r["extraction_status"], r["gpa_value"]) for r in E.extract_stats(docs, "id", "text", "url", "score").collect()}
    assert got == {1: ("accepted", 3.71), 2: ("needs_review_partial_stats", None), 3: ("needs_review_partial_stats", 3.71), 4: ("no_relevant_stats_found", None)}
    assert E.extract_stats(docs.limit(0), "id", "text", "url", "score").count() == 0


def test_profile_section_ends(spark):
    far = "MCAT/GPA Information " + "filler " * 300 + "Mean MCAT Score 510 Avg. Cum. Undergrad GPA Score 3.6"
    docs = spark.createDataFrame([(1, "Mean MCAT Score: 509 Avg Cum Undergrad GPA Score 3.65 2024-25"), (2, far), (3, None), (4, "MCAT/GPA Information Mean MCAT Score 510 Avg. Cum. Undergrad GPA Score 4.9")], "id long, text string")
    got = {r["id"]: (r["extraction_status"], r["mcat_mean"], r["gpa_mean"], r["academic_year"]) for r in E.extract_profile(docs, "id", "text", F.lit("DO"), F.lit(True)).collect()}
    assert got == {1: ("accepted", 509.0, 3.65, "2024-2025"), 2: ("no_relevant_stats_found", None, None, ""), 3: ("no_relevant_stats_found", None, None, ""), 4: ("needs_review_partial_stats", 510.0, 4.9, "")}


def test_gate_names_other_programs(spark):
    rows = [(1, "accepted", "MD", "https://e.edu/md", "Class profile"), (2, "accepted", "DO", "https://e.edu/md", ""), (3, "accepted", "md", "https://e.edu/pa-program/class", ""), (4, "needs_review_partial_stats", "MD", "https://e.edu/x", "Nursing class"), (5, "no_relevant_stats_found", "DO", "https://e.edu/dental", None)]
    df = spark.createDataFrame(rows, "id long, extraction_status string, degree string, url string, title string").withColumn("review_status", F.lit("approved"))
    got = {r["id"]: (r["extraction_status"], r["review_status"], r["confidence"] != "") for r in E.gate_extractions(df, F.col("degree"), F.col("url"), F.col("title")).collect()}
    assert got == {1: ("accepted", "approved", True), 2: ("rejected_other_degree", "needs_review", False), 3: ("rejected_other_program", "needs_review", False), 4: ("rejected_other_program", "needs_review", False), 5: ("no_relevant_stats_found", "needs_review", False)}


def test_windows_give_the_rows_of_whole_texts(spark, sf_dir):
    """On every document with lines of statistics at its start, middle and end, and on texts that leave patterns unbounded."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", S.compact_text("text").alias("text"))
    forms = F.array(*[F.lit(" ".join(t.split())) for t in CASES])
    line = lambda k: F.element_at(forms, (F.col("doc_id") % len(CASES) + k).cast("int") % len(CASES) + 1)
    half = F.floor(F.length("text") / 2).cast("int")
    mixed = F.concat_ws(" ", line(0), F.substring("text", F.lit(1), half), line(3), F.expr("substring(text, int(length(text) / 2) + 1)"), line(7))
    odd = [(-1, "mcat  \n\t 510 median of the class", ), (-2, "science " + "7" * 30 + " gpa 3.5"), (-3, "510" + "x" * 400 + " mcat"), (-4, "class of 2020 " + "y " * 1300 + "median gpa 3.7 mcat 510"), (-5, "3.5 3.6 gpa 3.7 mcat 510.5-512.25 GPA RANGE 3.1 to 3.9")]
    docs = docs.select("doc_id", mixed.alias("text")).union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = [E.stat_spans(docs, "doc_id", "text", w).filter("form <> 'year'").exceptAll(E.stat_spans(docs, "doc_id", "text", not w).filter("form <> 'year'")).count() for w in (True, False)]
    assert rows == [0, 0]
    flags = docs.select(F.col("doc_id").alias("id"), F.lit(False).alias("is_image"))
    found = [E.stat_candidates(E.stat_spans(docs, "doc_id", "text", w), flags) for w in (True, False)]
    assert found[0].exceptAll(found[1]).count() == 0 and found[1].exceptAll(found[0]).count() == 0 and found[0].count() > 500
    assert all(E.reach(p) for p in (*(p for *_, p in (*P.VALUE_PATTERNS, *P.RANGE_PATTERNS)), *(p[1] for p in P.PAIR_PATTERNS)))


def test_latest_year_without_values(spark):
    """The latest year of a class counts, wherever it stands and with blanks of any number; other years don't."""
    texts = ["x " * 3000 + "Class of 2024, entering class 2026. " + "y " * 3000 + "class of 2025 in 2031", "  class   of  2023 ", "class of 2022", "in 2021", None, "2020 CLAſſ PROFILE 2019 class profile"]
    docs = spark.createDataFrame([(i, t, "u", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, url string, score double")
    got = {r["doc_id"]: r["year"] for r in E.extract_stats(docs, "doc_id", "text", "url", "score").collect()}
    assert got == {0: 2026, 1: 2023, 2: None, 3: None, 4: None, 5: 2019}


def test_patterns_are_tried_only_where_their_letters_stand():
    """Every run of letters that a pattern is said to need is in its matches, and most texts lack one."""
    assert E.needed(r"(?:m\s*cat)(?:\s+score)?\s+between\s+\d") == "between" and E.needed(r"(?:ab|cd)e?") == "" and E.needed(r"(?:xy)+z") == "xy"
    finder = E._Finder(r"(?:m\s*cat)\s+between\s+(?P<low>\d)", "mcat", True)
    assert [m["low"] for m in finder.hits("MCAT Between 5", None, "mcat between 5")] == ["5"] and not list(finder.hits("MCAT 5", None, "mcat 5"))
