"""Read models and outputs: entity and card nodes, lists and methodology, guided groups, public payloads, the run order."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scoreframe.functions import scalar as S
from scoreframe.operators import workflow as W

# Limits of a guided list by strategy: share of the target and least number to start, share and least number
# to compare, and how many beyond the target are worth research.
STRATEGIES = {"balanced_list": (0.4, 8, 1.0, 0, 10), "safer_list": (0.32, 6, 0.8, 10, 4), "reach_heavy_list": (0.48, 10, 1.0, 0, 20)}
# Core fields of an entity, services by kind, and sections that only a local payload has.
CORE_FIELDS = ("decision_rank", "mcat_average", "gpa_average")
SERVICES = {"MD": "AMCAS", "DO": "AACOMAS"}
NEXT_ACTIONS = {
    "accepted": "compare offer and revisit final fit", "waitlisted": "track waitlist movement and update letters", "interview": "prepare for interview",
    "applied": "track secondary, interview, and decision updates", "applying": "submit primary and secondary materials",
}
HUMAN_FIELDS = (
    "why_kept", "why_cut", "assigned_research_owner", "primary_deadline", "secondary_fee", "submitted_primary", "secondary_received",
    "secondary_submitted", "interview_invite", "notes",
)
PRIORITIES = ("highest", "high", "medium", "low")


def _text(*cols: str) -> Column:
    return S.first_present(*[F.col(c).cast("string") for c in cols])


def identity(kind: str, key: str) -> list[Column]:
    """Columns that every node begins with."""
    return [F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("node_id"), F.lit(kind).alias("node_type"), F.col(key)]


def missing_fields() -> Column:
    """Names of the absent fields of a wide entity row."""
    tests = [
        ("decision_rank", F.col("decision_rank").isNull()), ("mcat_average", F.col("mcat_average").isNull()), ("gpa_average", F.col("gpa_average").isNull()), ("cost", F.coalesce("cost_out", "cost_basis").isNull()),
        ("admissions_policy", F.coalesce("policy_count", F.lit(0)) == 0), ("letter_requirements", F.coalesce("letter_count", F.lit(0)) == 0),
    ]
    return W.node_status(tests, CORE_FIELDS)


def with_status(entities: DataFrame) -> DataFrame:
    """entities with missing_fields, readiness, confidence and warning_chips. Wide rows: rank, averages, costs, counts,
    rank_confidence, score_warnings, hard_no."""
    df = entities.withColumn("_s", missing_fields())
    df = df.withColumn("missing_fields", F.col("_s.missing")).withColumn("readiness", F.col("_s.readiness")).drop("_s")
    n, confidence = F.size("missing_fields"), F.col("rank_confidence")
    chip = lambda label, severity: F.struct(label.alias("label"), F.lit(severity).alias("severity"))
    chips = [
        F.when(n > 0, chip(F.concat(n.cast("string"), F.lit(" missing fields")), "warn")), F.when(S.missing(F.col("score_warnings")).isNotNull(), chip(F.lit("score warnings"), "warn")),
        F.when(confidence.isin("partial", "provisional"), chip(F.concat(confidence, F.lit(" confidence")), "warn")), F.when(F.coalesce("hard_no", F.lit(False)), chip(F.lit("hard no"), "error")),
    ]
    return df.withColumn("confidence", F.coalesce(S.missing(confidence), "readiness")).withColumn("warning_chips", F.array_compact(F.array(*chips)))


def entity_nodes(entities: DataFrame, key: str, mode: str = "public") -> dict[str, DataFrame]:
    """Read models of wide entity rows: entity, card, ranking card, compare card and profile with snapshot cards. Only the
    local mode carries the reviewer's state."""
    df = with_status(entities)
    place = F.array_join(F.array_compact(F.array(S.missing(F.col("city")), S.missing(F.col("state")))), ", ")
    route = F.concat(F.lit("/entities/"), F.col("slug"))
    who = F.struct(F.col("name"), F.col("kind"), F.col("city"), F.col("state"), place.alias("location"), route.alias("route"))
    rank = F.struct("decision_rank", "rank_band", "rank_confidence", "tier", "bucket")
    averages = F.struct("mcat_average", "gpa_average", "rate_band")
    costs = F.struct("cost_in", "cost_out", "cost_basis")
    money = lambda c: F.coalesce(S.missing(S.fmt_currency(F.col(c))), F.lit("Missing"))
    snapshot = lambda name, value: F.struct(F.lit(name).alias("card"), value.cast("string").alias("value"))
    cards = F.array(
        snapshot("decision_rank", F.coalesce(F.col("decision_rank").cast("string"), F.lit("Unranked"))), snapshot("mcat_average", F.coalesce(S.missing(S.fmt_trimmed(F.col("mcat_average"), 1)), F.lit("Missing"))),
        snapshot("gpa_average", F.coalesce(S.missing(S.fmt_trimmed(F.col("gpa_average"), 2)), F.lit("Missing"))), snapshot("cost_in", money("cost_in")), snapshot("cost_out", money("cost_out")),
        snapshot("quality", F.coalesce("quality_band", F.lit("Missing"))),
    )
    requirements = F.struct(F.coalesce("policy_count", F.lit(0)).alias("policies"), F.coalesce("letter_count", F.lit(0)).alias("letters"))
    reviewer = [F.struct(F.coalesce("visibility", F.lit("visible")).alias("visibility"), "decision_status").alias("reviewer_state")] if mode == "local" else []
    active = F.coalesce("active", F.lit(True)).alias("active")
    return {
        "entity": df.select(*identity("entity", key), who.alias("identity"), active, F.coalesce("quality_band", F.lit("missing")).alias("source_confidence")),
        "card": df.select(*identity("card", key), who.alias("identity"), rank.alias("rank_summary"), averages.alias("averages"), costs.alias("costs"), "readiness", "confidence", "missing_fields", "warning_chips"),
        "ranking_card": df.select(*identity("ranking_card", key), "name", "decision_rank", "rank_band", "rank_confidence", "overall_score", "admissions_score", "attendance_score", "tier", "bucket", "positive_drivers", "negative_drivers", "missing_fields", "readiness"),
        "compare_card": df.select(*identity("compare_card", key), who.alias("identity"), rank.alias("rank_fit"), averages.alias("admissions_facts"), costs.alias("cost_facts"), requirements.alias("requirements"), "missing_fields", "readiness", *reviewer),
        "profile": df.select(*identity("profile", key), who.alias("identity"), cards.alias("snapshot_cards"), "readiness", "confidence", "missing_fields", *reviewer),
    }


def list_nodes(lists: DataFrame, ranked: DataFrame, key: str, rank: str) -> DataFrame:
    """List rows (list_id, title, readiness) with the 25 best ids and the 10 first of them, none for a provisional list."""
    best = ranked.filter(F.col(rank).isNotNull()).select(rank, key).orderBy(rank, key).limit(25)
    ids = best.agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(key).alias("id")))).alias("ids")).select(F.col("ids.id").alias("ids"))
    shown = F.when(F.coalesce("readiness", F.lit("provisional")).isin("ready", "partial"), F.col("ids")).otherwise(F.slice("ids", 1, 0))
    # one row of 25 ids
    return lists.crossJoin(F.broadcast(ids)).withColumn("ids", shown).withColumn("top_ids", F.slice("ids", 1, 10))


def methodology_nodes(rows: DataFrame, area: str, formula: str, order: Sequence[str]) -> DataFrame:
    """(area, formula, components): one node per area, its first formula in order, and its rows; methodology tables are small."""
    cells = F.array_sort(F.collect_list(F.struct(*order, *[c for c in rows.columns if c not in (area, *order)])))
    first = F.min_by(S.missing(F.col(formula)), F.when(S.missing(F.col(formula)).isNotNull(), F.struct(*order)))
    return rows.groupBy(F.coalesce(S.missing(F.col(area)), F.lit("scoring")).alias("area")).agg(F.coalesce(first, F.lit("see the table")).alias("formula"), cells.alias("components"))


def final_application_list(master: DataFrame, rankings: DataFrame, visibility: DataFrame, dossiers: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """The final list with status, reasons, next action, priority and service; a human field of an existing row stays where
    it isn't blank. Tables have one row per key but rankings, whose best one counts. master: (key, name, kind); rankings:
    (key, decision_rank, rank_band, tier, bucket); visibility: (key, visibility); dossiers: (key, decision_status,
    research_status, interest_level); existing: (key, human fields)."""
    best = rankings.groupBy(key).agg(F.min_by(F.struct("decision_rank", "rank_band", "tier", "bucket"), F.struct(F.coalesce("decision_rank", F.lit(9999)), "rank_band", "tier", "bucket")).alias("r"))
    df = master.join(dossiers, key).join(visibility, key, "left").join(best, key, "left").select(*master.columns, "decision_status", "research_status", "interest_level", "visibility", "r.*")
    listed = W.final_list(df.withColumn("visibility", F.coalesce("visibility", F.lit("visible"))), key, "decision_status", "visibility", "decision_rank").select(key, "priority")
    df = df.join(listed, key).withColumn("status", F.lower(S.clean(F.col("decision_status"))))
    actions = F.create_map(*[F.lit(x) for kv in NEXT_ACTIONS.items() for x in kv])
    researched = F.lower(S.clean(F.col("research_status"))).isin("researched", "ready_to_decide")
    action = F.coalesce(F.try_element_at(actions, F.col("status")), F.when(researched, "decide whether to submit application").otherwise("research score card and decide whether to apply"))
    part = lambda word, c: F.concat(F.lit(word), S.missing(F.col(c).cast("string")))
    why = F.concat(F.concat_ws("; ", F.concat(F.lit("Marked "), "status", F.lit(" in the score card")), part("rank ", "decision_rank"), part("rank band ", "rank_band"), part("tier ", "tier"), part("bucket ", "bucket"), part("interest ", "interest_level")), F.lit("."))
    service = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SERVICES.items() for x in kv]), F.upper(S.clean(F.col("kind")))), F.lit(""))
    made = df.select(*master.columns, "decision_rank", F.col("bucket").alias("current_bucket"), "status", why.alias("why_kept"), action.alias("next_action"), "priority", service.alias("service"))
    human = [c for c in HUMAN_FIELDS if c in existing.columns]
    before = existing.select(key, *[S.missing(F.col(c)).alias(f"_{c}") for c in human])
    fresh = lambda c: F.col(c) if c in made.columns else F.lit("")
    both = made.join(before, key, "left")
    return both.select(*[c for c in made.columns if c not in human], *[F.coalesce(f"_{c}", fresh(c)).alias(c) for c in human])


def final_order() -> list[Column]:
    return [F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority")), F.coalesce("decision_rank", F.lit(9999)), F.col("name")]


def guided_groups(ranked: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Every ranked entity under every answer row: its group, chips of reason, risk and missing data (7, 6 and 6 at most).
    ranked: (key, state, hidden, decision_rank, overall_score, coverage, mcat_average, gpa_average, cost_basis,
    quality_band, score_warnings); answers: (answer_id, home_state, home_group, avoided array, strategy, target,
    include_reach, cost_sensitivity), at most 10,000 rows."""
    if answers.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 answer rows: group them in parts")
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for n, v in STRATEGIES.items() for x in (n, float(v[i]))]), F.when(F.col("strategy").isin(*STRATEGIES), F.col("strategy")).otherwise("balanced_list"))
    limits = answers.withColumn("target", F.coalesce("target", F.lit(25))).withColumn("start", F.greatest(pick(1), F.ceil(F.col("target") * pick(0)))).withColumn("compare", F.greatest(pick(3), F.ceil(F.col("target") * pick(2)))).withColumn("reach", F.col("target") + pick(4))
    df = ranked.crossJoin(F.broadcast(limits))
    rank = F.coalesce("decision_rank", F.lit(9999))
    hidden, same = F.coalesce("hidden", F.lit(False)), F.coalesce(F.col("state") == F.col("home_state"), F.lit(False))
    lacking = F.col("overall_score").isNull() | (F.coalesce("coverage", F.lit(0.0)) < 0.35) | F.col("mcat_average").isNull() | F.col("gpa_average").isNull()
    group = (
        F.when(hidden | F.coalesce(F.array_contains("avoided", F.col("state")), F.lit(False)), "lower_priority_or_hidden").when(lacking, "need_more_data").when(same & F.coalesce("home_group", F.lit(False)), "home_options")
        .when(rank <= F.col("start"), "start_here").when((rank > F.col("compare")) & (rank <= F.col("reach")) & (F.coalesce("include_reach", F.lit("yes")) != "no"), "reach_to_research").when(rank <= F.col("compare"), "compare_next").otherwise("lower_priority_or_hidden")
    )
    df = df.withColumn("group", group)
    is_in = lambda g: F.col("group") == g
    reasons = [(F.col("decision_rank").isNotNull(), F.concat(F.lit("Selected rank "), F.col("decision_rank").cast("string"))), (is_in("home_options"), F.lit("Home option")), (same, F.lit("In-state context")), (F.col("cost_basis").isNotNull(), F.lit("Cost context applied"))]
    risks = [
        (hidden, F.lit("Hidden")), (is_in("need_more_data"), F.lit("Incomplete data")), (F.coalesce("coverage", F.lit(0.0)) < 0.5, F.lit("Low score coverage")),
        ((F.col("cost_basis") > 90000) & F.col("cost_sensitivity").isin("high", "debt_averse"), F.lit("High cost signal")), (F.col("decision_rank") > F.col("target"), F.lit("Outside target count")),
        (F.col("quality_band").isNotNull() & ~F.col("quality_band").isin("high", "medium"), F.concat(F.lit("Stats quality "), "quality_band")), (S.missing(F.col("score_warnings")).isNotNull(), F.lit("Score warning present")),
    ]
    lacks = [(F.col("gpa_average").isNull(), F.lit("GPA avg")), (F.col("mcat_average").isNull(), F.lit("MCAT avg")), (F.col("overall_score").isNull(), F.lit("selected rank"))]
    return df.select("answer_id", key, "group", W.why_bullets(reasons, 7).alias("reasons"), W.why_bullets(risks, 6).alias("risks"), W.why_bullets(lacks, 6).alias("missing"))


def direction_texts(contributions: DataFrame, keys: Sequence[str], most: int = 6) -> DataFrame:
    """(keys, bullets): texts of the factors of live contributions (component, score, weight, included) that help (7.5 and
    more) or hurt (4.5 and less), the weightiest first."""
    side = F.when(F.col("score") >= 7.5, "helps").when(F.col("score") <= 4.5, "hurts")
    said = F.concat(S.component_label(F.col("component")), F.lit(" "), side, F.lit(" at "), S.fmt_trimmed(F.col("score"), 1))
    rows = contributions.filter("included").select(*keys, F.struct((-F.col("weight")).alias("w"), F.col("component").alias("c"), said.alias("t")).alias("b")).filter("b.t IS NOT NULL")
    return rows.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list("b")), 1, most).alias("b")).select(*keys, F.col("b.t").alias("bullets"))


def edited_rows(current: DataFrame, stored: DataFrame, keys: Sequence[str], fields: Sequence[str], version: str) -> DataFrame:
    """Export of the rows that differ from the stored ones, with the schema version; null and blank are alike."""
    tag = lambda df, mark: df.select(*keys, F.struct(*[S.clean(F.col(f).cast("string")).alias(f) for f in fields]).alias(mark))
    both = tag(current, "_new").join(tag(stored, "_old"), list(keys), "left")
    blank = F.struct(*[F.lit("").alias(f) for f in fields])
    return both.filter(F.col("_new") != F.coalesce("_old", blank)).select(F.lit(version).alias("schema_version"), *keys, "_new.*")


def publish(tables: dict[str, DataFrame], path: str, mode: str, private_tables: Sequence[str], private_columns: Sequence[str]) -> list[str]:
    """Writes each table as JSON lines under path; the public mode leaves private tables out and drops private columns, at
    the top and in structs one level deep. Gives the names written."""
    if mode not in ("public", "local"):
        raise ValueError(f"unknown mode {mode!r}")
    written = []
    for name, df in tables.items():
        if mode == "public":
            if name in private_tables:
                continue
            df = without_columns(df, private_columns)
        df.write.mode("overwrite").json(f"{path}/{name}")
        written.append(name)
    return written


def without_columns(df: DataFrame, private: Sequence[str]) -> DataFrame:
    kept = []
    for field in df.schema.fields:
        inner = [f.name for f in getattr(field.dataType, "fields", [])]
        if field.name in private:
            continue
        gone = [n for n in inner if n in private]
        kept.append(F.col(f"`{field.name}`").dropFields(*[f"`{n}`" for n in gone]).alias(field.name) if gone and len(gone) < len(inner) else F.col(f"`{field.name}`"))
    return df.select(*kept)


def leak_check(spark: SparkSession, path: str, names: Sequence[str], secrets: DataFrame, secret: str) -> DataFrame:
    """(table, secret, n): lines of published tables that hold a secret value. Secrets are a list of planted values, 1,000
    at most, which every line is searched for at once."""
    values = [r[0] for r in secrets.filter(S.missing(F.col(secret)).isNotNull()).select(secret).distinct().limit(1_001).collect()]
    if len(values) > 1_000:
        raise ValueError("more than 1,000 secrets: check them in parts")
    hits = None
    for name in names:
        lines = spark.read.text(f"{path}/{name}").select(F.lit(name).alias("table"), F.explode(F.array_compact(F.array(*[F.when(F.contains("value", F.lit(v)), F.lit(v)) for v in values]) if values else F.array().cast("array<string>"))).alias("secret"))
        hits = lines if hits is None else hits.unionByName(lines)
    return hits.groupBy("table", "secret").agg(F.count("*").alias("n"))


class ValidationError(ValueError):
    """Rows of error severity stop a run."""


Step = tuple[str, Callable[[dict[str, DataFrame]], dict[str, DataFrame]], bool]


def run_all(tables: dict[str, DataFrame], validate: Callable[[dict[str, DataFrame]], DataFrame], steps: Sequence[Step], at: str | None = None, stamp: str = "") -> dict[str, DataFrame]:
    """Runs the steps (name, function, whether it is validated before) in order over the tables; each function gives tables
    that are added or replaced. An issue of error severity before a step stops the run there.

    With ``at``, a folder that driver and executors share, every table of a step is written there once and read again, so
    that no later step or gate computes an earlier one; a step that is written whole gets an entry in the manifest. A run
    in the same folder takes up after the last good step whose entry fits: same steps before it, same schemas of the
    inputs, and the same ``stamp``, by which the caller tells versions of the inputs apart. Without ``at`` all stays lazy
    but the gates."""
    now = dict(tables)
    told = hashlib.sha256("\n".join([stamp, *(f"{n} {df.schema.json()}" for n, df in sorted(tables.items()))]).encode())
    for nth, (name, step, gated) in enumerate(steps):
        told.update(f"\n{nth} {name} {gated}".encode())
        entry = f"{at}/{nth:03}-{name}" if at else ""
        written = _entry(tables, entry, told.hexdigest()) if at else None
        if written is None:
            if gated and not validate(now).filter(F.col("severity") == "error").isEmpty():
                raise ValidationError(f"errors before {name}")
            made = step(now)
            if at:
                made = _written(made, entry, told.hexdigest())
            now.update(made)
        else:
            now.update(written)
    return now


_ENTRY = "stamp string, tables array<struct<name:string,schema:string>>"


def _written(made: dict[str, DataFrame], entry: str, stamp: str) -> dict[str, DataFrame]:
    """The tables of a step, written and read again; the manifest entry comes last, so a step that broke off has none."""
    out = {}
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{entry}/{name}")
        out[name] = df.sparkSession.read.schema(df.schema).parquet(f"{entry}/{name}")
    session = next(iter(made.values())).sparkSession if made else SparkSession.active()
    session.createDataFrame([(stamp, [(n, df.schema.json()) for n, df in out.items()])], _ENTRY).coalesce(1).write.mode("overwrite").json(f"{entry}/_manifest")
    return out


def _entry(tables: dict[str, DataFrame], entry: str, stamp: str) -> dict[str, DataFrame] | None:
    """The stored tables of a step that was finished under this stamp, else None."""
    spark = next(iter(tables.values())).sparkSession if tables else SparkSession.active()
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{entry}/_manifest/_SUCCESS")
    if not done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(done):
        return None
    row = spark.read.schema(_ENTRY).json(f"{entry}/_manifest").first()
    if row is None or row.stamp != stamp:
        return None
    return {t.name: spark.read.schema(StructType.fromJson(json.loads(t.schema))).parquet(f"{entry}/{t.name}") for t in row.tables}
