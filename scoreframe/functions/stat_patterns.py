"""Patterns of published admission statistics: an exam total of 472 to 528 and grade averages up to 4.0."""

# What the patterns look for. A value pattern has one of the groups after, before, after_ocr, after_short
# and after_label; a range pattern has low and high; a pair pattern has several values at once.
VALUE_PATTERNS = (
    ("mcat", "mcat", r"(?:(?:median|mean|average|avg)\s+)?(?:total\s+)?mcat(?:\s+score)?[^0-9]{0,60}(?P<after>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)"
                     r"|(?P<before>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)[^a-z0-9]{0,30}(?:(?:median|mean|average|avg)\s+)?(?:total\s+)?mcat(?:\s+score)?"
                     r"|(?:mcat)(?:\s+\d{1,5}(?:,\d{3})?){1,3}\s+(?P<after_ocr>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)"),
    ("mcat_class_value", "mcat", r"(?:m\s*cat)[^.]{0,220}?(?P<after>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)[^.]{0,180}?(?:average|mean|median|matriculating|entering|class)"),
    ("mcat_2015", "mcat", r"(?:m\s*cat)\s+2015\s+score[^0-9]{0,60}(?P<after>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)"),
    ("mcat_section_total", "mcat", r"(?:m\s*cat).{0,260}?\btotal\s+(?P<after>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)"),
    ("mcat_score_suffix", "mcat", r"(?:(?:median|mean|average|avg)\s+(?:total\s+)?)?(?:m\s*cat).{0,160}?(?P<after>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)\s+score"),
    ("mcat_trailing_mean", "mcat", r"(?P<before>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)\s+\(range:\s*\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?\s*(?:-|–|—|to)\s*"
                                   r"\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?\)\s+(?:mean|average|median)\s+m\s*cat"),
    ("mcat15_composite", "mcat", r"(?:(?:median|mean|average|avg)\s+)?m\s*cat15\s+composite\s+(?P<after>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)"),
    ("gpa", "gpa", r"(?:(?:median|mean|average|avg)\s+)?(?:(?:overall|cumulative|undergrad|undergraduate)\s+)?gpa(?:[^0-9]{0,40}(?:overall|cumulative|undergrad|undergraduate))?[^0-9]{0,60}(?P<after>\b[2345]\.\d{1,3})"
                   r"|(?P<before>\b[2345]\.\d{1,3})[^a-z0-9]{0,30}(?:(?:median|mean|average|avg)\s+)?(?:(?:overall|cumulative|undergrad|undergraduate)\s+)?gpa"
                   r"|(?:gpa)(?:\s+\d{1,5}(?:,\d{3})?){1,3}\s+(?P<after_ocr>\b[2345]\.\d{1,3})"),
    ("gpa_class_value", "gpa", r"(?:(?:g\s*pa)[^.]{0,220}?(?P<after>\b[234]\.\d{1,3})[^.]{0,180}?(?:matriculating|entering|class))"
                               r"|(?:(?P<before>\b[234]\.\d{1,3})[^.]{0,180}?(?:average|mean|median)[^.]{0,100}?(?:overall|cumulative|undergrad|undergraduate|total)?\s*g\s*pa[^.]{0,180}?(?:matriculating|entering|class))"),
    ("gpa_trailing_label", "gpa", r"(?P<before>\b[234]\.\d{1,3})\s+(?:average|mean|median)\s+(?:(?:overall|cumulative|undergraduate|total|bcpm|science)\s+)?g\s*pa"),
    ("gpa_trailing_mean", "gpa", r"(?P<before>\b[234]\.\d{1,3})\s+\(range:\s*\b[234]\.\d{1,3}\s*(?:-|–|—|to)\s*\b[234]\.\d{1,3}\)\s+(?:mean|average|median)\s+(?:overall|cumulative|undergrad|undergraduate|total)\s+g\s*pa"),
    ("science_gpa", "science_gpa", r"(?:(?:median|mean|average|avg)\s+)?(?:(?:overall\s+)?(?:science|bcpm)(?:\s+\d+)?\s+g\s*pa)[^0-9]{0,60}(?P<after>\b[234]\.\d{1,3})"
                                   r"|(?:(?:median|mean|average|avg)\s+)(?:science|bcpm)[^0-9]{0,60}(?P<after_short>\b[234]\.\d{1,3})"
                                   r"|g\s*pa\s*(?:-|–|—|:)?\s*(?:science|bcpm)[^0-9]{0,60}(?P<after_label>\b[234]\.\d{1,3})"
                                   r"|(?P<before>\b[234]\.\d{1,3})[^a-z0-9]{0,40}(?:(?:median|mean|average|avg)\s+)?(?:(?:overall\s+)?(?:science|bcpm)(?:\s+\d+)?\s+g\s*pa)"),
    ("science_trailing_mean", "science_gpa", r"(?P<before>\b[234]\.\d{1,3})\s+\(range:\s*\b[234]\.\d{1,3}\s*(?:-|–|—|to)\s*\b[234]\.\d{1,3}\)\s+(?:mean|average|median)\s+(?:science|bcpm)\s+g\s*pa"),
)
RANGE_PATTERNS = (
    ("mcat_range", "mcat", r"(?:(?:median|mean|average|avg)?\s*(?:total\s+)?mcat(?:\s+score)?(?:\s+range)?|mcat\s+score\s+range)[^0-9]{0,60}(?P<low>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)"
                           r"\s*(?:-|–|—|to)\s*(?P<high>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)"),
    ("mcat_between", "mcat", r"(?:m\s*cat)(?:\s+score)?\s+between\s+(?P<low>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)\s+and\s+(?P<high>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)"),
    ("mcat_trailing_range", "mcat", r"(?P<low>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)\s*(?:-|–|—|to)\s*(?P<high>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)[^a-z0-9]{0,20}(?:m\s*cat)(?:\s+score)?\s+range"),
    ("gpa_range", "gpa", r"(?:(?:median|mean|average|avg)?\s*(?:(?:overall|cumulative|undergrad|undergraduate)\s+)?gpa(?:\s+range)?|gpa\s+range)[^0-9]{0,60}(?P<low>\b[234]\.\d{1,3})\s*(?:-|–|—|to)\s*(?P<high>\b[234]\.\d{1,3})"),
    ("gpa_trailing_range", "gpa", r"(?P<low>\b[234]\.\d{1,3})\s*(?:-|–|—|to)\s*(?P<high>\b[234]\.\d{1,3})[^a-z0-9]{0,20}(?:(?:overall|cumulative|undergrad|undergraduate)\s+)?g\s*pa\s+range"),
    ("science_range", "science_gpa", r"(?:(?:median|mean|average|avg)?\s*(?:overall\s+)?(?:science|bcpm)(?:\s+\d+)?\s+gpa(?:\s+range)?|(?:science|bcpm)(?:\s+\d+)?\s+gpa\s+range)[^0-9]{0,60}"
                                     r"(?P<low>\b[234]\.\d{1,3})\s*(?:-|–|—|to)\s*(?P<high>\b[234]\.\d{1,3})"),
)
#: Fixed values of pair patterns: (name, pattern, metric or "" for the context's, points on top of the context's, all
#: points or None, characters of context). Groups are named by the kind of value; gpa_low and gpa_high are a range.
PAIR_PATTERNS = (
    ("respective", r"(?:average|mean|median)?\s*gpa\s+and\s+mcat\s+scores?[^.]{0,180}?(?P<gpa_low>\b[234]\.\d{1,3})(?:\s*(?:-|–|—|to)\s*(?P<gpa_high>\b[234]\.\d{1,3}))?"
                   r"\s+and\s+(?P<mcat>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)[^.]{0,40}?respectively", "", 2, None, 180),
    ("table", r"(?P<metric>mean|average|median)\s+(?P<gpa>\b[234]\.\d{1,3})\s+(?P<mcat>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)", "row", 2, None, 180),
    ("year_grid", r"class\s+profiles?.{0,260}?(?P<year>20\d{2})(?:\s+20\d{2}){0,5}.{0,360}?m\s*cat\s+score\s+(?P<mcat>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)"
                  r"(?:\s+\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?){0,5}\s+average\s+g\s*pa\s+(?P<gpa>\b[234]\.\d{1,3})", "average", 0, 6, 80),
    ("total", r"average\s+g\s*pa.{0,180}?\btotal:?\s*(?P<gpa>\b[234]\.\d{1,3}).{0,120}?average\s+m\s*cat(?:\s+score)?\s*(?P<mcat>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)", "average", 2, None, 180),
    ("academic_table", r"academics\s+sci\s+ao\s+g\s*pa\s+m\s*cat.{0,220}?median\s+(?P<science_gpa>\b[234]\.\d{1,3})\s+\b[234]\.\d{1,3}\s+(?P<gpa>\b[234]\.\d{1,3})\s+"
                       r"(?P<mcat>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)", "median", 6, None, 180),
    ("entering_values_first", r"average\s+g\s*pa\s+and\s+m\s*cat.{0,180}?entering\s+class\s+of\s+(?P<year>20\d{2})\s+was:?\s+(?P<gpa>\b[234]\.\d{1,3})\s+(?:overall\s+|cumulative\s+|undergraduate\s+)?g\s*pa"
                              r".{0,160}?(?P<mcat>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)\s+m\s*cat", "average", 0, 8, 180),
    ("entering_labels_first", r"(?P<year>20\d{2})\s+entering\s+class\s+average\s+m\s*cat(?:\s+composite)?\s+was\s+(?P<mcat>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)"
                              r"\s+and\s+the\s+average\s+(?:cumulative\s+)?g\s*pa\s+was\s+(?P<gpa>\b[234]\.\d{1,3})", "average", 0, 6, 180),
    ("gpa_range_median", r"(?:overall|cumulative|undergraduate|total)?\s*g\s*pa\s+\b[234]\.\d{1,3}\s*(?:-|–|—|to)\s*\b[234]\.\d{1,3}\s+(?P<gpa>\b[234]\.\d{1,3})", "median", 4, None, 180),
    ("mcat_range_median", r"m\s*cat(?:\s+total\s+score)?\s+\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?\s*(?:-|–|—|to)\s*\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?\s+"
                          r"(?P<mcat>\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)", "median", 4, None, 180),
)
#: Rows of the pattern "table" count within so many characters of such a header.
TABLE_HEADER, TABLE_REACH = r"(?:category\s+)?g\s*pa\s+m\s*cat", 450
YEAR_PATTERNS = (
    r"(?:entering|matriculating|incoming)\s+class(?:\s+of)?\s+(20\d{2})", r"class\s+of\s+(20\d{2})", r"(20\d{2})\s+(?:entering|matriculating|incoming)\s+class",
    r"(20\d{2})\s+class\s+profile", r"admissions\s+profile\s+(20\d{2})",
)
# Words of requirements, words of class profiles, labels of grade averages that count and that don't.
MINIMUM_WORDS = ("minimum", "required", "requirement", "requirements", "must have", "eligible", "eligibility", "screen", "screening", "cutoff", "cut-off", "threshold")
PROFILE_WORDS = ("accepted", "average", "class profile", "class statistics", "enrolled", "entering class", "matriculated", "matriculants", "mean", "median", "profile")
SCIENCE_WORDS = ("science", "bcpm", "postbac", "post-bac")
OVERALL_WORDS = ("overall", "cumulative", "undergrad", "undergraduate", "total gpa", "total", "class gpa", "class")
GRADUATE_WORDS = ("graduate", "masters", "master's")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".tif", ".tiff")
# Labels of a profile page and the length of its section.
PROFILE_HEADER, PROFILE_SECTION = r"\bMCAT/GPA\s+Information\b", 1400
PROFILE_MCAT = r"\bMean\s+MCAT\s+Score\b\s*:?\s*(\b(?:47[2-9]|48\d|49\d|50\d|51\d|52[0-8])(?:\.\d)?)"
PROFILE_GPA = r"\bAvg\.?\s+Cum\.?\s+Undergrad\s+GPA\s+Score\b\s*:?\s*(\b[0-4](?:\.\d{1,3})?)"
PROFILE_OLDEST = r"\bOldest\s+MCAT\s+Considered\b\s*:?\s*((?:20\d{2}|[A-Za-z]+\s+20\d{2}|[0-1]?\d/[0-3]?\d/20\d{2}))"
PROFILE_LATEST = r"\bLatest\s+MCAT\s+Score\s+Accepted\b\s*:?\s*((?:20\d{2}|[A-Za-z]+\s+20\d{2}|[0-1]?\d/[0-3]?\d/20\d{2}))"
# Words of other programs in a url's path or a title.
OTHER_PROGRAMS = (
    "ba md", "dental", "dentistry", "dmd", "graduate program", "master of", "masters", "md phd", "md/phd", "mph", "mstp", "nursing",
    "occupational therapy", "pa admissions", "pa online", "pa program", "pharmacy", "physical therapy", "physician assistant",
    "school of dentistry", "veterinary",
)
