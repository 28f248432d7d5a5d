"""From five raw tables to a feature table: cohort, features, gates, comparator, attrition ledger.

Every step is a DataFrame operation on whole tables; gates are a few aggregates that are evaluated together and raised in
a fixed order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake import constants as C
from quorumlake.functions import cells
from quorumlake.operators import profile, relational
from quorumlake.sources import staging
from quorumlake.sources.extract import ExtractError, typed_failures
from quorumlake.sources.tables import read_table

KEY = "patientunitstayid"


def feature_names() -> list[str]:
    """The frozen list of features, in order."""
    pairs = lambda prefix, cols: [n for c in cols for n in (f"{prefix}{c}", f"{prefix}{c}__missing")]
    hot = [f"{col}={v or 'EMPTY'}" for col, levels in C.CATEGORICALS for v in levels]
    return [*pairs("", C.PATIENT_NUMERIC), "age_masked", *hot, *pairs("aps_", C.APS_NUMERIC), *pairs("apv_", C.APV_NUMERIC), "aps_present", "apv_present"]


def assert_no_leaks(names: list[str]) -> None:
    """Raises if a denied column is a feature: bare, prefixed, as a missing indicator or as a one-hot stem."""
    hits = []
    for name in names:
        stem = name.split("=")[0].removesuffix("__missing")
        for prefix in ("", "aps_", "apv_"):
            if stem.startswith(prefix) and stem[len(prefix) :] in C.LEAK_COLUMNS:
                hits.append(name)
    if hits:
        raise ExtractError(f"denied columns are features: {sorted(set(hits))}", "leak-column-in-features")


@dataclass
class Extract:
    """features: site_label, y, stay ids, comparator and all features, NULL where missing; ledger and counters beside it."""

    features: DataFrame
    ledger: DataFrame
    cross_site: dict
    cell_counts: dict[str, dict[str, int]]
    outcome_missing: dict[str, dict]
    warnings: list[str]


def staged(patient: DataFrame) -> DataFrame:
    """patient with what the selection needs, parsed once: ids, age, outcome, and how far each row gets."""
    rows = patient.select("*", cells.maybe_int(F.col("hospitalid")).alias("site_no"), cells.maybe_int(F.col(KEY)).alias("stay"), cells.age_years(F.col("age")).alias("age_value"),
                          cells.stripped(F.col(C.LABEL_COLUMN)).alias("outcome"), cells.maybe_int(F.col("patienthealthsystemstayid")).alias("admission"),
                          cells.maybe_float(F.col("unitvisitnumber")).alias("visit"), cells.maybe_float(F.col("hospitaladmitoffset")).alias("offset"))
    return rows.withColumn("site_label", F.concat(F.lit(C.SITE_PREFIX), F.col("site_no").cast("string"))).withColumn("y", F.col("outcome") == C.POSITIVE_LABEL)


def eligible() -> list[tuple[str, Column]]:
    """The successive conditions of the cohort, before one stay for each admission is chosen."""
    known = F.col("outcome").isin(C.POSITIVE_LABEL, C.NEGATIVE_LABEL)
    return [("site-parseable", F.col("site_no").isNotNull()), ("outcome-known", known), ("adult", F.coalesce(F.col("age_value") >= C.MIN_AGE, F.lit(False)) & F.col("stay").isNotNull())]


def select_cohort(patient: DataFrame, *, strict_levels: bool = True) -> tuple[DataFrame, DataFrame]:
    """(cohort, marked): one stay for each admission, and all rows with whether they are it (`selected`)."""
    rows = staging.staged(staged(patient), "patient")
    if strict_levels:
        odd = rows.where(F.col("site_no").isNotNull() & ~F.col("outcome").isin(C.POSITIVE_LABEL, C.NEGATIVE_LABEL, "")).select("outcome").distinct().limit(5).collect()
        if odd:
            raise ExtractError(f"outcome has levels {sorted(r[0] for r in odd)}", "unknown-outcome-level")
    passed = F.lit(True)
    for _, condition in eligible():
        passed = passed & condition
    good = rows.where(passed)
    twice = good.groupBy("stay").count().where("count > 1").orderBy("stay").limit(3).collect()
    if twice:
        raise ExtractError(f"stays appear twice: {[r['stay'] for r in twice]}", "duplicate-stay-id")
    cohort = relational.first_stay(good, admission="admission", stay="stay", visit="visit", offset="offset")
    if cohort.isEmpty():
        raise ExtractError("no stay is left", "empty-cohort")
    chosen = cohort.select("stay", F.lit(True).alias("selected"))
    return cohort, rows.join(chosen, "stay", "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


def parsed_cells(child: DataFrame, cohort: DataFrame, surrogate: str, columns: tuple[str, ...], prefix: str) -> DataFrame:
    """(stay, name, value, status) of the cells of the cohort's stays, a row for each cell.

    Of several rows of a stay that of the least surrogate id counts. Cells of all columns are parsed by one expression.
    """
    rows = child.select(cells.maybe_int(F.col(KEY)).alias("stay"), cells.maybe_int(F.col(surrogate)).alias("surrogate"), *columns).where("stay is not null")
    one = relational.keep_least_surrogate(relational.with_match(rows, cohort, "stay"), ["stay"], "surrogate")
    pairs = F.array(*[F.struct(F.lit(f"{prefix}{c}").alias("name"), F.col(c).alias("cell")) for c in columns])
    long = one.select("stay", F.explode(pairs).alias("c")).select("stay", "c.name", "c.cell")
    kinds = {"fio2": cells.sentinel_cell(F.col("cell"), "fio2"), "temperature": cells.sentinel_cell(F.col("cell"), "temperature")}
    parsed = cells.sentinel_cell(F.col("cell"))
    for c, kind in kinds.items():
        if c in columns:
            parsed = F.when(F.col("name") == f"{prefix}{c}", kind).otherwise(parsed)
    return long.select("stay", "name", parsed.alias("p")).select("stay", "name", "p.value", "p.status")


def linked(cohort: DataFrame, parsed: DataFrame, names: list[str], flag: str) -> DataFrame:
    """cohort with a column for each name and a presence flag."""
    wide = parsed.groupBy("stay").agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in names])
    return relational.with_presence(cohort, wide, "stay", flag)


def comparator(result: DataFrame, cohort: DataFrame) -> DataFrame:
    """(stay, version, comparator): the preferred version's prediction, even where it is missing."""
    rows = result.select(cells.maybe_int(F.col(KEY)).alias("stay"), cells.maybe_int(F.col("apachepatientresultsid")).alias("surrogate"), cells.stripped(F.col("apacheversion")).alias("version"), cells.sentinel_cell(F.col("predictedhospitalmortality"))["value"].alias("comparator"))
    rows = relational.with_match(rows.where("stay is not null"), cohort, "stay")
    return relational.prefer_version(relational.keep_least_surrogate(rows, ["stay", "version"], "surrogate"), "stay", "version", "comparator", C.VERSION_PREFERENCE)


def build(spark: SparkSession, folder: str, *, arm: str = "primary", strict_levels: bool = True) -> Extract:
    """The feature table of an arm. Raises ExtractError for a file that cannot be read, then by the first gate that fails, in a fixed order.

    Feature names are case-sensitive: set spark.sql.caseSensitive before features are written or picked by name.
    """
    if arm not in C.ARMS:
        raise ExtractError(f"arm {arm!r} is not one of {C.ARMS}", "unknown-arm")
    with typed_failures():  # each file is read once
        tables = {t: staging.staged(read_table(spark, folder, t), t) for t in C.TABLES}
    cohort, marked = select_cohort(tables["patient"], strict_levels=strict_levels)
    cohort = staging.staged(cohort, "cohort")
    n = cohort.count()

    drift = profile.level_drift(cohort, dict(C.CATEGORICALS)).where(F.col("other_share") > C.MAX_OTHER_SHARE).orderBy("name").collect()
    if drift:
        raise ExtractError(f"unlisted levels: { {r['name']: r['other_share'] for r in drift} }", "categorical-level-drift")

    patient_cells = {
        "age": F.struct(F.col("age_value").alias("value"), F.lit("ok").alias("status")), "admissionheight": cells.windowed_cell(F.col("admissionheight"), *C.WINDOW_HEIGHT_CM),
        "admissionweight": cells.windowed_cell(F.col("admissionweight"), *C.WINDOW_WEIGHT_KG), "pre_icu_hours": cells.windowed_cell(F.col("hospitaladmitoffset"), *C.WINDOW_PRE_ICU_HOURS, -1.0 / 60.0),
    }
    hot = {k: v for col, levels in C.CATEGORICALS for k, v in cells.one_hot(F.col(col), col, levels).items()}
    # some names differ in case alone (gender=Other, gender=OTHER), which a written table cannot hold: numbers until the end
    held = {k: f"hot_{i}" for i, k in enumerate(hot)}
    base = cohort.select("stay", "site_label", "y", "uniquepid", (cells.stripped(F.col("age")) == C.AGE_MASK_TOKEN).cast("double").alias("age_masked"), *[v.alias(f"{k}_cell") for k, v in patient_cells.items()], *[v.alias(held[k]) for k, v in hot.items()])
    base = base.select("*", *[F.col(f"{k}_cell.value").alias(k) for k in patient_cells], *[F.col(f"{k}_cell.status").alias(f"{k}_status") for k in patient_cells])
    for table in ("apacheApsVar", "apachePredVar", "apachePatientResult"):
        key = F.trim(F.col(KEY))
        bad, all_ = tables[table].agg(F.count_if((key != "") & cells.maybe_int(key).isNull()), F.count("*")).first()
        if all_ and bad / all_ > C.MAX_KEY_UNPARSEABLE_SHARE:
            raise ExtractError(f"{table}: {bad} of {all_} stay ids are not whole numbers", "unparseable-join-key")
    keys = cohort.select("stay")
    aps = parsed_cells(tables["apacheApsVar"], keys, "apacheapsvarid", C.APS_NUMERIC, "aps_")
    apv = parsed_cells(tables["apachePredVar"], keys, "apachepredvarid", C.APV_NUMERIC, "apv_")
    aps, apv, base = staging.staged(aps, "aps"), staging.staged(apv, "apv"), staging.staged(base, "base")
    wide = linked(base, aps, [f"aps_{c}" for c in C.APS_NUMERIC], "aps_present")
    wide = linked(wide, apv, [f"apv_{c}" for c in C.APV_NUMERIC], "apv_present")
    wide = wide.join(comparator(tables["apachePatientResult"], keys), "stay", "left")
    wide = staging.staged(wide, "wide")

    names = [*C.PATIENT_NUMERIC, *[f"aps_{c}" for c in C.APS_NUMERIC], *[f"apv_{c}" for c in C.APV_NUMERIC]]
    counts: dict[str, dict[str, int]] = {c: {} for c in names}
    own = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"{c}_status").alias("status")) for c in C.PATIENT_NUMERIC])
    told = aps.select("name", "status").unionAll(apv.select("name", "status")).unionAll(base.select(F.explode(own).alias("s")).select("s.name", "s.status"))
    for r in told.groupBy("name", "status").count().collect():  # a few rows for each column
        counts[r["name"]][r["status"]] = r["count"]
    outcome: dict[str, dict] = {}
    for flag in ("aps_present", "apv_present"):
        outcome[flag] = profile.prevalence_contrast(wide, F.col(flag) == 1.0, F.col("y")).first().asDict()
    def tokens(of: list[str]) -> dict[str, list[str]]:
        """The most frequent cells of these columns that are no numbers."""
        raw = cohort.select("stay", *[F.struct(F.lit(c).alias("name"), F.col("hospitaladmitoffset" if c == "pre_icu_hours" else c).alias("cell")).alias(f"_{c}") for c in C.PATIENT_NUMERIC])
        long = raw.select(F.explode(F.array(*[f"_{c}" for c in C.PATIENT_NUMERIC])).alias("c")).select("c.*")
        for table, columns, prefix in (("apacheApsVar", C.APS_NUMERIC, "aps_"), ("apachePredVar", C.APV_NUMERIC, "apv_")):
            pairs = F.array(*[F.struct(F.lit(f"{prefix}{c}").alias("name"), F.col(c).alias("cell")) for c in columns])
            long = long.unionByName(tables[table].select(F.explode(pairs).alias("c")).select("c.*"))
        found: dict[str, list[str]] = {}
        for r in profile.unknown_tokens(long.where(F.col("name").isin(of)), ["name"]).orderBy("name", "place").collect():  # four a column at most
            found.setdefault(r["name"], []).append(r["token"])
        return found

    warnings = _gate(n, counts, outcome, arm, tokens)

    features = wide.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}__missing") for c in names])
    final = feature_names()
    assert_no_leaks(final)
    if len(final) != C.N_FEATURES:
        raise ExtractError(f"{len(final)} features", "feature-width-mismatch")
    complete = (F.col("aps_present") == 1.0) & (F.col("apv_present") == 1.0)
    arms = {"primary": F.lit(True), "apache-linked": complete, "apache-complete": complete & F.col("comparator").isNotNull()}
    out = features.where(arms[arm]).select("stay", "site_label", "y", "uniquepid", "comparator", *[F.col(f"`{held.get(c, c)}`").alias(c) for c in final])
    if out.isEmpty():
        raise ExtractError(f"no stay is left in arm {arm}", "empty-cohort")

    link = features.select("stay", (F.col("aps_present") == 1.0).alias("has_aps"), F.col("version").isNotNull().alias("has_result"), arms["apache-complete"].alias("is_complete"))
    all_rows = marked.join(link, "stay", "left")
    steps = [("raw-unit-stays", F.lit(True)), *eligible(), ("first-stay", F.col("selected")), ("primary-cohort", F.col("selected"))]
    ledger = relational.attrition(all_rows, steps, "site_no", F.col("y"))
    for i, (name, flag) in enumerate((("apache-aps-linked", "has_aps"), ("apache-result-linked", "has_result"), ("apache-complete-arm", "is_complete")), start=7):
        one = relational.attrition(all_rows.where(F.col("selected")), [(name, F.col(flag))], "site_no", F.col("y"))
        ledger = ledger.unionByName(one.withColumn("step_no", F.lit(i)))
    cross = relational.keys_of_many(cohort.where("trim(uniquepid) <> ''"), "uniquepid", "site_label").first().asDict()
    if (cross["share"] or 0.0) > C.MAX_CROSS_SITE_SHARE:
        warnings.append(f"{cross['n_multi']} patients are at more than one site")
    return Extract(out, ledger, cross, counts, outcome, warnings)


def release_check(extract: Extract) -> DataFrame:
    """(name, n, expected, matches): the raw stays and sites of an extract's ledger against those of the release; reported, not raised."""
    first = extract.ledger.where(F.col("step") == C.ATTRITION_STEPS[0])
    pairs = F.array(F.struct(F.lit("unit-stays").alias("name"), F.col("n_rows").cast("long").alias("n")), F.struct(F.lit("sites").alias("name"), F.col("n_sites").cast("long").alias("n")))
    return profile.identities(first.select(F.explode(pairs).alias("p")).select("p.*"), {"unit-stays": C.REFERENCE_UNIT_STAYS, "sites": C.REFERENCE_SITES})


def _gate(n: int, counts: dict, outcome: dict, arm: str, tokens: Callable[[list[str]], dict]) -> list[str]:
    """Warnings; raises in the order negatives, tokens, coverage, outcome."""
    apache = {k: v for k, v in counts.items() if k.startswith(("aps_", "apv_"))}
    negative = {k: v.get("other_negative", 0) for k, v in apache.items() if v.get("other_negative", 0)}
    if over := {k: v for k, v in negative.items() if v / n > C.MAX_NEGATIVE_SHARE}:
        raise ExtractError(f"negative cells other than -1: {over}", "unexpected-negative-sentinel")
    if over := {k: v["unparseable"] for k, v in counts.items() if v.get("unparseable", 0) / n > C.MAX_UNPARSEABLE_SHARE}:
        raise ExtractError(f"cells that are no numbers: {over}, such as {tokens(sorted(over))}", "unrecognised-null-token")
    if arm == "primary" and n >= C.MIN_OUTCOME_STRATUM:
        if starved := {k: v["n_present"] for k, v in outcome.items() if v["n_present"] < C.MIN_OUTCOME_STRATUM}:
            raise ExtractError(f"hardly any stay is linked: {starved}", "apache-coverage-collapse")
    if arm == "primary":
        told = {k: v["ratio"] for k, v in outcome.items() if min(v["n_present"], v["n_absent"]) >= C.MIN_OUTCOME_STRATUM and v["ratio"] is not None and v["ratio"] > C.MAX_OUTCOME_PREVALENCE_RATIO}
        if told:
            raise ExtractError(f"absence tells of the outcome: {told}", "outcome-informative-missingness")
    return [f"negative cells other than -1, taken as missing: {negative}"] if negative else []
