"""A look at an extract before anything is fitted: is it the release, what is linked where, does absence tell of the outcome."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake import constants as C
from quorumlake.functions import cells
from quorumlake.operators import profile, relational, sites
from quorumlake.plans import etl
from quorumlake.sources import staging
from quorumlake.sources.extract import ROW, ExtractError, typed_failures
from quorumlake.sources.tables import read_table

STRATA = ["numbedscategory", "teachingstatus", "region"]


@dataclass
class Preflight:
    """identities: a row for each table, the sites, the patients and the stays; per_site: strata and linkage; missing: a row
    for each linked cell; worst: its largest ratios; cells, dispersion, tokens: of all numeric columns of the two linked
    tables, by table and name, the dispersion over the cohort's sites; windows: which units oxygen and temperature come
    in; ordinals: counts of the coma scale's levels; rows_per_stay: by table; stay_hours: lengths of stay of linked and
    unlinked stays; projection: how a split would come out; aborts: why a build of this extract would raise."""

    identities: DataFrame
    per_site: DataFrame
    missing: DataFrame
    worst: DataFrame
    cells: DataFrame
    dispersion: DataFrame
    tokens: DataFrame
    windows: DataFrame
    ordinals: DataFrame
    rows_per_stay: DataFrame
    stay_hours: DataFrame
    projection: dict
    aborts: list[str]
    warnings: list[str]


def preflight(spark: SparkSession, folder: str, *, expect_reference: bool = True, least: int = C.MIN_OUTCOME_STRATUM) -> Preflight:
    """Profiles the five tables. Raises ExtractError for tables that are cut short or not UTF-8, and, if the release is
    expected, where a table has another number of rows.

    Cells are profiled over whole tables. Of several rows of a stay in a linked table the first of the file is held
    against the outcome; of several rows of a hospital the last gives its strata. A ratio counts as large
    where both sides have at least `least` stays.
    """
    with typed_failures():  # each file is read once
        tables = {t: staging.staged(read_table(spark, folder, t, numbered=True), t) for t in C.TABLES}
    counts = {t: df.count() for t, df in tables.items()}  # a number for each of the five tables
    people = tables["patient"].agg(F.count_distinct(cells.maybe_int(F.col("hospitalid"))).alias("sites"), F.count_distinct(F.when(cells.stripped(F.col("uniquepid")) != "", cells.stripped(F.col("uniquepid")))).alias("patients")).first()
    counts |= {"sites": people["sites"], "patients": people["patients"], "unit-stays": counts["patient"]}
    expected = C.REFERENCE_ROW_COUNTS | {"sites": C.REFERENCE_SITES, "patients": C.REFERENCE_PATIENTS, "unit-stays": C.REFERENCE_UNIT_STAYS}
    identities = profile.identities(spark.createDataFrame(sorted(counts.items()), "name string, n long"), expected)
    other = {t: n for t, n in counts.items() if n != expected[t]}
    if other and expect_reference:
        raise ExtractError(f"not the release: {other}", "reference-mismatch")
    warnings = [f"not the release: {other}"] if other else []

    cohort, _ = etl.select_cohort(tables["patient"], strict_levels=False)
    drift = profile.level_drift(cohort, dict(C.CATEGORICALS)).where(F.col("other_share") > C.MAX_OTHER_SHARE).orderBy("name").collect()
    hours = cells.maybe_float(F.col("unitdischargeoffset")) / 60.0 if "unitdischargeoffset" in cohort.columns else F.lit(None).cast("double")
    cohort = staging.staged(cohort.select("stay", F.col("site_label").alias("site_id"), "y", hours.alias("hours")), "preflight")
    linked = {}
    contrasts = []
    long = None
    for table, columns, prefix in (("apacheApsVar", C.APS_NUMERIC, "aps_"), ("apachePredVar", C.APV_NUMERIC, "apv_")):
        parsed = [cells.sentinel_cell(F.col(c), *([c] if c in ("fio2", "temperature") else []))["value"].alias(f"{prefix}{c}") for c in columns]
        rows = tables[table].select(cells.maybe_int(F.col(etl.KEY)).alias("stay"), ROW, *parsed).join(cohort.select("stay", "y"), "stay")
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("cell")) for c in columns])
        own = tables[table].select(F.lit(table).alias("table"), cells.maybe_int(F.col(etl.KEY)).alias("stay"), F.explode(pairs).alias("c")).select("table", "stay", "c.name", "c.cell")
        long = own if long is None else long.unionByName(own)
        contrasts.append(profile.outcome_missing(rows, "stay", ROW, [f"{prefix}{c}" for c in columns], F.col("y")))
        linked[prefix] = rows.select("stay").distinct()
    missing = staging.staged(contrasts[0].unionByName(contrasts[1]), "missing")
    worst = profile.worst_missing(missing, least)
    for r in worst.collect():  # six rows at most
        if r["ratio"] > C.MAX_OUTCOME_PREVALENCE_RATIO:
            warnings.append(f"absence of {r['name']} tells of the outcome: {r['ratio']:.3f}")

    flagged = cohort
    for prefix, keys in linked.items():
        flagged = relational.with_presence(flagged, keys, "stay", f"{prefix}present")
    per = sites.linkage(flagged, F.col("y"), {p.rstrip("_"): F.col(f"{p}present") == 1.0 for p in linked})
    hospital = tables["hospital"].select(F.concat(F.lit(C.SITE_PREFIX), cells.maybe_int(F.col("hospitalid")).cast("string")).alias("site"), ROW, *STRATA)
    # a site that comes twice is given by its last row
    per_site = sites.in_label_order(sites.with_strata(per, hospital, "site", ROW, STRATA), "site_id")
    profiles = staging.staged(profile.cell_profiles(long, ["table", "name"]), "cells")
    placed = long.join(cohort.select("stay", "site_id"), "stay")
    unknown = cells.maybe_float(F.col("cell"))
    units = long.where("table = 'apacheApsVar' and name in ('fio2', 'temperature')").select("name", unknown.alias("v"))
    windows = None
    for name in ("fio2", "temperature"):
        one = profile.window_counts(units.where(F.col("name") == name), profile.unit_windows(F.col("v"), name))
        windows = one if windows is None else windows.unionByName(one)
    scale = long.where("table = 'apacheApsVar'").where(F.col("name").isin("eyes", "motor", "verbal"))
    ordinals = scale.groupBy("name", cells.stripped(F.col("cell")).alias("value")).agg(F.count("*").alias("n"))
    per_stay, bad_keys = None, {}
    for table in ("apacheApsVar", "apachePredVar", "apachePatientResult"):
        keyed = tables[table].select(cells.maybe_int(F.col(etl.KEY)).alias("stay"), cells.stripped(F.col(etl.KEY)).alias("text"))
        one = profile.rows_per_key(keyed, "stay").select(F.lit(table).alias("table"), "rows", "keys")
        per_stay = one if per_stay is None else per_stay.unionByName(one)
        bad_keys[table] = keyed.where("stay is null and text <> ''").count() / max(counts[table], 1)
    aps, apv = F.col("aps_present") == 1.0, F.col("apv_present") == 1.0
    stay_hours = profile.lengths(flagged, "hours", {"aps-present": aps, "aps-absent": ~aps, "aps-absent-positive": ~aps & F.col("y"), "apv-present": apv, "apv-absent": ~apv})

    n_sites, n_stays = cohort.select("site_id").distinct().count(), cohort.count()
    rest = max(0, n_sites - C.N_TARGET_SITES)
    train, aux = int(rest * C.SPLIT_FRACTIONS[0]), int(rest * C.SPLIT_FRACTIONS[1])
    projection = {"n_sites": n_sites, "target": C.N_TARGET_SITES, "train": train, "aux": aux, "cal": rest - train - aux, "sites_ok": n_sites >= C.MIN_TOTAL_SITES, "cal_ok": rest - train - aux >= C.MIN_CAL_CLUSTERS}
    aborts = [] if projection["sites_ok"] else [f"too-few-sites: {n_sites}"]
    aborts += [] if projection["cal_ok"] else [f"too-few-cal-clusters: {projection['cal']}"]
    aborts += [f"categorical-level-drift: {r['name']}" for r in drift]
    for r in profiles.orderBy("table", "name").collect():  # a row for each numeric column
        if r["n_other_negative"] / max(r["n"], 1) > C.MAX_NEGATIVE_SHARE:
            aborts.append(f"unexpected-negative-sentinel: {r['table']}.{r['name']}")
        if r["n_unparseable"] / max(r["n"], 1) > C.MAX_UNPARSEABLE_SHARE:
            aborts.append(f"unrecognised-null-token: {r['table']}.{r['name']}")
    aborts += [f"unparseable-join-key: {t}" for t, share in bad_keys.items() if share > C.MAX_KEY_UNPARSEABLE_SHARE]
    for r in flagged.agg(*[F.struct(F.count_if(c).alias("n"), F.avg(F.when(c, F.col("y").cast("double"))).alias("at"), F.count_if(~c).alias("m"), F.avg(F.when(~c, F.col("y").cast("double"))).alias("off")).alias(k) for k, c in (("aps", aps), ("apv", apv))]).first().asDict().items():
        tag, e = r
        if n_stays >= C.MIN_OUTCOME_STRATUM and e["n"] < C.MIN_OUTCOME_STRATUM:
            aborts.append(f"apache-coverage-collapse: {tag}")
        elif min(e["n"], e["m"]) >= C.MIN_OUTCOME_STRATUM and e["at"] and e["off"] / e["at"] > C.MAX_OUTCOME_PREVALENCE_RATIO:
            aborts.append(f"outcome-informative-missingness: {tag}")
    if aborts:
        warnings.append(f"a build would raise: {aborts}")
    by = ["table", "name"]
    return Preflight(identities, per_site, missing, worst, profiles, profile.cell_dispersion(placed, by, "site_id"), profile.unknown_tokens(long, by), windows, ordinals, per_stay, stay_hours, projection, aborts, warnings)
