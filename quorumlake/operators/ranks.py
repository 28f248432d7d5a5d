"""Rank statistics: areas under curves with averaged ties, and screens of many features at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake import constants as C
from quorumlake.sources.staging import cut

from .order_statistics import exact_quantiles, with_rows_before


def unpivoted(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """(keep..., feature, value): a row for each feature of each record."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.feature", "p.value")


def rank_auc(records: DataFrame, value: str, label: str, by: list[str] = ()) -> DataFrame:
    """(by..., n_pos, n_neg, auc): Mann-Whitney area with averaged ties; NULL where a class is absent.

    Records are counted by value first, so ranks run over distinct values, not over records, and over ranges of them that
    count on from offsets (see order_statistics), so no task holds all values of a group. NULL values are left out.
    """
    per = records.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col(label).cast("boolean")).alias("n1"))
    ranked = with_rows_before(per, "v", by=by).withColumn("mid", F.col("before") + (F.col("n") + 1) / 2.0)
    got = ranked.groupBy(*by).agg(F.sum("n1").alias("n_pos"), F.sum(F.col("n") - F.col("n1")).alias("n_neg"), F.sum(F.col("n1") * F.col("mid")).alias("ranks"))
    auc = F.try_divide(F.col("ranks") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0, F.col("n_pos").cast("double") * F.col("n_neg"))
    return got.select(*by, "n_pos", "n_neg", auc.alias("auc"))


def outcome_screen(df: DataFrame, features: list[str], label: str, review: float) -> DataFrame:
    """(feature, kind, n, auc, low_prevalence, high_prevalence, flagged): how much each feature alone tells of the label.

    kind: degenerate (one value or none), binary (two) or continuous. Prevalences are those of records below the first
    and above the last decile for continuous features, of the two values for binary ones. Flagged from `review` on, on
    either side of a half.
    """
    long = unpivoted(df, features, [label]).where("value is not null and not isnan(value)")
    cuts = exact_quantiles(long, "value", {"q1": 0.1, "q9": 0.9}, ["feature"])
    ends = long.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    between = long.join(F.broadcast(ends), "feature").groupBy("feature").agg(F.count_if((F.col("value") > F.col("lo")) & (F.col("value") < F.col("hi"))).alias("inside"))
    shape = cut(cuts.join(ends, "feature").join(between, "feature"))  # a row for each feature
    shape = shape.withColumn("kind", F.when(F.col("lo") == F.col("hi"), "degenerate").when(F.col("inside") == 0, "binary").otherwise("continuous"))
    edges = shape.select("feature", "kind", "n", F.when(F.col("kind") == "binary", F.col("lo")).otherwise(F.col("q1")).alias("low_cut"), F.when(F.col("kind") == "binary", F.col("hi")).otherwise(F.col("q9")).alias("high_cut"))
    y = F.col(label).cast("double")
    sides = long.join(F.broadcast(edges.select("feature", "low_cut", "high_cut")), "feature").groupBy("feature").agg(  # one row for each feature
        F.avg(F.when(F.col("value") <= F.col("low_cut"), y)).alias("low_prevalence"), F.avg(F.when(F.col("value") >= F.col("high_cut"), y)).alias("high_prevalence"))
    aucs = rank_auc(long, "value", label, ["feature"])
    out = edges.join(aucs, "feature", "left").join(sides, "feature", "left")
    real = F.col("kind") != "degenerate"
    return out.select("feature", "kind", "n", F.when(real, F.col("auc")).alias("auc"), "low_prevalence", "high_prevalence", F.coalesce(real & (F.abs(F.col("auc") - 0.5) >= review - 0.5), F.lit(False)).alias("flagged"))


def decile_contrast(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, decile, n, prevalence, least, most): how the label's prevalence runs over the tenths of each feature.

    A value lies in the tenth numbered by how many of the nine exact cuts are below it; tenths that ties leave empty are absent.
    """
    long = unpivoted(df, features, [label]).where("value is not null and not isnan(value)")
    cuts = exact_quantiles(long, "value", {f"c{i}": i / 10 for i in range(1, 10)}, ["feature"])
    cuts = cut(cuts.select("feature", F.array(*[f"c{i}" for i in range(1, 10)]).alias("cuts")))  # a row for each feature
    own = F.size(F.filter("cuts", lambda c: c < F.col("value"))) + 1
    return long.join(F.broadcast(cuts), "feature").groupBy("feature", own.alias("decile")).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("prevalence"), F.min("value").alias("least"), F.max("value").alias("most"))


def leak_alarm(records: DataFrame, score: str, ablated: str, label: str, auc_cap: float = C.LEAK_AUC_CAP, drop_cap: float = C.LEAK_DROP_CAP, by: list[str] = ()) -> DataFrame:
    """(by..., auc, auc_ablated, ablation_drop, auc_alarm, ablation_alarm): is a held-out score too good to be true?

    ablated: the score of a head fitted without the missing-value indicators. An area above auc_cap, or a loss above
    drop_cap without the indicators, raises an alarm; where a class is absent nothing does.
    """
    both = rank_auc(unpivoted(records, [score, ablated], [*by, label]), "value", label, [*by, "feature"])
    got = both.groupBy(*by).agg(*[F.max(F.when(F.col("feature") == c, F.col("auc"))).alias(n) for c, n in ((score, "auc"), (ablated, "auc_ablated"))])
    drop = F.col("auc") - F.col("auc_ablated")
    return got.select(*by, "auc", "auc_ablated", drop.alias("ablation_drop"), F.coalesce(F.col("auc") > auc_cap, F.lit(False)).alias("auc_alarm"), F.coalesce(drop > drop_cap, F.lit(False)).alias("ablation_alarm"))
