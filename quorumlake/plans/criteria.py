"""Failure criteria that are declared before a run, as rows of a table, and their verdicts over its results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorumlake import constants as C

from .replicated import POOLED

CRITERIA = "name string, leg string, measure string, relation string, bound double, scope string"
#: Witnesses that a verdict names.
SHOWN = 5


def declared(spark: SparkSession, delta: float = C.DELTA) -> DataFrame:
    """(name, leg, measure, relation, bound, scope): the criteria of the protocol.

    A leg holds where all its rows do at one witness of the scope; a criterion fires where one of its legs holds.
    """
    return spark.createDataFrame([
        ("validity", "exceedance", "exceed_rate", ">", delta, "run"),
        ("feasibility", "none-certifies", "n_certified", "<", 1.0, "run"),
        ("feasibility", "low-coverage", "mean_coverage", "<", C.MIN_OPERATIVE_COVERAGE, "run"),
        ("too-good", "discrimination", "auc", ">", C.LEAK_AUC_CAP, "replicate"),
        ("too-good", "missingness-ablation", "ablation_drop", ">", C.LEAK_DROP_CAP, "replicate"),
        ("too-good", "unfalsifiable-success", "strict_coverage", ">", C.SUCCESS_COVERAGE_ALARM, "replicate"),
        ("too-good", "unfalsifiable-success", "strict_risk", "<", C.SUCCESS_RISK_ALARM, "replicate"),
        ("scope", "few-sites", "n_sites", "<", float(C.MIN_REPORTED_SITES), "run"),
    ], CRITERIA)


def observations(outcomes: DataFrame, leaks: DataFrame, n_sites: DataFrame) -> DataFrame:
    """(scope, witness, measure, value): what criteria are held against, NULL values left out.

    outcomes: those of a replicated run; leaks: (replicate, auc, ablation_drop); n_sites: one row, the cohort's sites.
    The operative rung of a replicate is the strictest that its pooled run certifies.
    """
    pooled = outcomes.where(F.col("pool") == POOLED)
    operative = pooled.where("certified").groupBy("replicate").agg(F.min_by(F.struct("coverage", "risk_exceeds"), "alpha").alias("o"))
    run = operative.agg(
        F.count("*").cast("double").alias("n_certified"), F.avg(F.col("o.risk_exceeds").cast("double")).alias("exceed_rate"), F.avg("o.coverage").alias("mean_coverage"))
    strict = pooled.where(F.col("certified") & (F.col("alpha") == C.ALPHA_LADDER[0])).select(F.col("replicate").cast("string").alias("witness"), F.col("coverage").alias("strict_coverage"), F.col("risk").alias("strict_risk"))

    def long(df: DataFrame, scope: str, *measures: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures])
        rows = df.select(F.lit(scope).alias("scope"), F.col("witness") if "witness" in df.columns else F.lit("run").alias("witness"), F.explode(pairs).alias("p"))
        return rows.select("scope", "witness", "p.measure", "p.value").where("value is not null")

    judged = leaks.select(F.col("replicate").cast("string").alias("witness"), "auc", "ablation_drop")
    return long(run, "run", "n_certified", "exceed_rate", "mean_coverage").unionByName(long(n_sites, "run", "n_sites")).unionByName(
        long(strict, "replicate", "strict_coverage", "strict_risk")).unionByName(long(judged, "replicate", "auc", "ablation_drop"))


def verdicts(criteria: DataFrame, seen: DataFrame) -> DataFrame:
    """(name, leg, fired, leg_fired, n_hits, n_seen, lowest, highest, witnesses): a row for each leg of each criterion.

    fired: whether any leg of the criterion holds. n_seen: witnesses with a value for all rows of the leg; a leg that
    nothing was seen for does not hold. lowest, highest: of the values of the leg's first measure by name. witnesses: the
    first of those at which it holds, by name. Relations are <, <=, >, >=, =; all criteria are judged in one pass.
    """
    legs = criteria.groupBy("name", "leg", "scope").agg(F.count("*").alias("rows"), F.min("measure").alias("first_measure"))
    v, b = F.col("value"), F.col("bound")
    relation = F.col("relation")
    met = F.when(relation == "<", v < b).when(relation == "<=", v <= b).when(relation == ">", v > b).when(relation == ">=", v >= b).when(relation == "=", v == b)
    held = criteria.join(seen, ["scope", "measure"]).groupBy("name", "leg", "scope", "witness").agg(
        F.count("*").alias("known"), F.count_if(met).alias("met"), F.min_by("value", "measure").alias("value"))
    judged = legs.join(held, ["name", "leg", "scope"], "left").withColumn("hit", F.col("met") == F.col("rows")).withColumn("whole", F.col("known") == F.col("rows"))
    got = judged.groupBy("name", "leg").agg(
        F.count_if("hit").alias("n_hits"), F.count_if("whole").alias("n_seen"), F.min("value").alias("lowest"), F.max("value").alias("highest"),
        F.slice(F.sort_array(F.collect_list(F.when(F.col("hit"), F.col("witness")))), 1, SHOWN).alias("w"))
    fired = got.groupBy("name").agg((F.sum("n_hits") > 0).alias("fired"))
    return got.join(fired, "name").select("name", "leg", "fired", (F.col("n_hits") > 0).alias("leg_fired"), "n_hits", "n_seen", "lowest", "highest", F.array_join("w", "|").alias("witnesses"))
