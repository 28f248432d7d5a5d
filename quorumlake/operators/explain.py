"""Who is answered and why: composition of the answered set, features behind abstention, calibration, comparators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake import constants as C
from quorumlake.functions import heads
from quorumlake.functions.intervals import binomial_exceedances

from .ranks import rank_auc
from .resampling import seeded


def composition(records: DataFrame, answered: Column, p: str = "p", y: str | None = None, rho: float = 1.0) -> DataFrame:
    """(n_answered, predicted, expected, oracle): shares of positives in the answered set.

    predicted: by the hard label; expected: mean probability after its odds are multiplied by rho; oracle: by y.
    """
    clipped = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1.0 - 1e-12))
    odds = clipped / (1.0 - clipped) * rho
    return records.where(answered).agg(
        F.count("*").alias("n_answered"), F.avg((F.col(p) >= 0.5).cast("double")).alias("predicted"), F.avg(odds / (1.0 + odds)).alias("expected"),
        F.avg(F.col(y).cast("double") if y else F.lit(None).cast("double")).alias("oracle"),
    )


def abstention_profile(records: DataFrame, phi: str, answered: Column, by: list[str] = ()) -> DataFrame:
    """(by..., feature, mean_answered, mean_declined, gap, place): mean |share of the logit| of answered and declined records.

    Ordered by |gap|, ties by feature. No rows for a group of which either side is empty.
    """
    long = records.select(*by, answered.alias("a"), F.posexplode(phi).alias("feature", "v"))
    size = F.abs(F.col("v"))
    means = long.groupBy(*by, "feature").agg(F.avg(F.when(F.col("a"), size)).alias("mean_answered"), F.avg(F.when(~F.col("a"), size)).alias("mean_declined"))
    means = means.where("mean_answered is not null and mean_declined is not null").withColumn("gap", F.col("mean_answered") - F.col("mean_declined"))
    return means.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(F.abs("gap")), "feature")))  # a row for each feature


def stable_drivers(profiles: DataFrame, replicate: str = "replicate") -> DataFrame:
    """(feature, replicates, mean_gap, ci95, n_top, top_share, is_mode, stable): what many profiles say of a feature alike.

    profiles: abstention_profile by replicate. ci95: half the width of a 95 % interval of the mean gap (1.96 standard
    errors), NULL for one replicate. n_top: how often the feature has the largest gap; the mode is the feature that most
    often does, ties by feature; it is stable where that is at least half of the replicates.
    """
    n = F.count("*")
    got = profiles.groupBy("feature").agg(n.alias("replicates"), F.avg("gap").alias("mean_gap"), (1.96 * F.stddev_samp("gap") / F.sqrt(n)).alias("ci95"), F.count_if(F.col("place") == 1).alias("n_top"))
    every = W.partitionBy(F.lit(0))  # a row for each feature
    share = F.col("n_top") / F.sum("n_top").over(every)
    first = F.row_number().over(every.orderBy(F.desc("n_top"), "feature")) == 1
    return got.withColumns({"top_share": share, "is_mode": first}).withColumn("stable", F.col("is_mode") & (F.col("top_share") >= 0.5))


def evaluated_moves(records: DataFrame, head: heads.Head, id_col: str, tau: float, *, x: str = "x", logit: str = "logit", seed: int = C.SEED) -> DataFrame:
    """(n_declined, n_evaluated, n_unflippable, top_flips, random_flips, top_flip_rate, random_flip_rate): does the first move of a ranking do what it says?

    Each declined record that can be brought to an answer is scored anew after its smallest single move, and after a move
    of the same length, in the more favourable direction, of a feature drawn at random, seeded by the record's id.
    """
    n_features = len(head.coef)
    rows = records.select(F.col(id_col).alias("id"), F.col(x).alias("x"), F.col(logit).alias("logit"))
    rows = rows.withColumns(heads.ranked_moves(head, F.col("x"), F.col("logit"), tau)).where("cf_declined")
    fine = F.col("cf_flips") & (F.size("cf_moves") > 0)
    top = F.get("cf_moves", F.lit(0))
    drawn = F.pmod(seeded(seed, "counterfactual", F.col("id")), F.lit(n_features)).cast("int")
    sign = F.when(F.col("logit") >= 0, 1.0).otherwise(-1.0)
    weight = F.get(F.array(*[F.lit(float(c)) for c in head.coef]), drawn)
    length = F.abs(top["dz"])
    flips = lambda feature, dz: heads.answered(heads.scored(heads.moved_alone(head, F.col("x"), feature, dz))["score"], tau)
    judged = rows.select(fine.alias("fine"), flips(top["feature"], top["dz"]).alias("top"), flips(drawn, F.when(sign * weight >= 0, length).otherwise(-length)).alias("random"))
    got = judged.agg(
        F.count("*").alias("n_declined"), F.count_if("fine").alias("n_evaluated"), F.count_if(~F.col("fine")).alias("n_unflippable"),
        F.count_if(F.col("fine") & F.col("top")).alias("top_flips"), F.count_if(F.col("fine") & F.col("random")).alias("random_flips"))
    return got.select("*", *[F.try_divide(F.col(f"{k}_flips").cast("double"), F.col("n_evaluated")).alias(f"{k}_flip_rate") for k in ("top", "random")])


def binned(records: DataFrame, value: Column, edges: list[float], measures: dict[str, Column], *, right_closed: bool = False) -> DataFrame:
    """(bin, low, high, n, measures...): aggregates by bins [low, high), or (low, high] with the first closed.

    Empty bins stay, with n = 0 and NULL measures.
    """
    spark = records.sparkSession
    label = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        low, high = F.lit(edges[i]), F.lit(edges[i + 1])
        inside = ((value > low) | ((value == low) if i == 0 else F.lit(False))) & (value <= high) if right_closed else (value >= low) & (value < high)
        label = F.when(inside, i).otherwise(label)
    got = records.withColumn("bin", label).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), *[m.alias(k) for k, m in measures.items()])
    frame = spark.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(len(edges) - 1)], "bin int, low double, high double")
    return frame.join(got, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def exceedance_bins(sites: DataFrame, n: str, over: str, alpha: float, edges: list[float]) -> DataFrame:
    """(bin, low, high, n, observed, reference): how often sites are over alpha, beside how often chance alone would put them there.

    sites: a row for each answered set, its size and whether its error rate is over alpha. reference: the mean over the
    bin's sites of the chance that a set of that size is, if every answer were wrong with probability alpha; the chance
    is worked out once for each distinct size. Sets of no records have none.
    """
    sizes = sites.where(F.col(n) > 0).select(F.col(n).alias("_n")).distinct()
    chances = sizes.withColumn("_chance", binomial_exceedances(F.col("_n"), alpha))
    both = sites.join(chances, F.col(n) == F.col("_n"))
    return binned(both, F.col(n).cast("double"), edges, {"observed": F.avg(F.col(over).cast("double")), "reference": F.avg("_chance")})


def confusion(records: DataFrame, y: str = "y", pred: str = "pred", by: list[str] = ()) -> DataFrame:
    """(by..., tp, fp, tn, fn, sensitivity, specificity, ppv, npv, error, fn_share, always_negative_error)."""
    yes, said = F.col(y), F.col(pred)
    got = records.groupBy(*by).agg(F.count_if(yes & said).alias("tp"), F.count_if(~yes & said).alias("fp"), F.count_if(~yes & ~said).alias("tn"), F.count_if(yes & ~said).alias("fn"))
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    ratio = {"sensitivity": (tp, tp + fn), "specificity": (tn, tn + fp), "ppv": (tp, tp + fp), "npv": (tn, tn + fn), "error": (fp + fn, tp + fp + tn + fn), "fn_share": (fn, fp + fn), "always_negative_error": (tp + fn, tp + fp + tn + fn)}
    return got.select("*", *[F.try_divide(a, b).alias(k) for k, (a, b) in ratio.items()])


def comparator(records: DataFrame, p: str, y: str = "y", by: list[str] = (), err: str | None = None) -> DataFrame:
    """(by..., n, n_available, available_share, brier, auc) of a rival's probability where it has one.

    With err, whether one's own answer is wrong, also subset_error: its share among the records that have a rival.
    """
    has = F.col(p).isNotNull()
    yes = F.col(y).cast("double")
    own = [F.avg(F.when(has, F.col(err).cast("double"))).alias("subset_error")] if err else []
    base = records.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(has).alias("n_available"), F.avg(F.when(has, (F.col(p) - yes) * (F.col(p) - yes))).alias("brier"), *own)
    base = base.withColumn("available_share", F.try_divide(F.col("n_available").cast("double"), F.col("n")))
    auc = rank_auc(records, p, y, by).select(*by, "auc")
    if by:
        return base.join(auc, list(by), "left")
    return base.withColumn("_one", F.lit(1)).join(auc.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")


def representative_cases(records: DataFrame, id_col: str, score: str, tau: float) -> DataFrame:
    """(highest, lowest, nearest): ids of the surest, the least sure and the closest record to the threshold."""
    first = lambda key: F.min(F.struct(key.alias("k"), F.col(id_col).alias("id")))["id"]
    return records.agg(first(-F.col(score)).alias("highest"), first(F.col(score)).alias("lowest"), first(F.abs(F.col(score) - tau)).alias("nearest"))


def browse(records: DataFrame, *, answered: Column | None = None, contains: str | None = None, id_col: str = "record_id", site: object = None, score: tuple[float, float] | None = None) -> DataFrame:
    """The records that meet all given filters: answered or not, a part of the id, a site, a score in [low, high)."""
    out = records if answered is None else records.where(answered)
    if contains is not None:
        out = out.where(F.col(id_col).cast("string").contains(contains))
    if site is not None:
        out = out.where(F.col("site_id") == F.lit(site))
    return out if score is None else out.where((F.col("score") >= F.lit(score[0])) & (F.col("score") < F.lit(score[1])))


def leading_features(records: DataFrame, id_col: str, phi: str, top: int = 12, *, names: list[str] | None = None, search: str = "", modified: tuple[int, ...] = ()) -> DataFrame:
    """(id, feature, phi, n_shown, n_total): each record's features of largest share of the logit, ties by place, and those modified.

    search: only features whose name holds this text, in any case; n_total counts them. modified: places of features that
    are shown in any case if they match.
    """
    pairs = F.transform(F.col(phi), lambda v, j: F.struct((-F.abs(v)).alias("size"), j.alias("feature"), v.alias("phi")))
    if search:
        fit = [j for j, n in enumerate(names or []) if search.lower() in n.lower()]
        pairs = F.filter(pairs, lambda p: p["feature"].isin(fit))
    ranked = F.array_sort(pairs)
    best = F.concat(F.slice(ranked, 1, top), F.filter(F.slice(ranked, top + 1, 1 << 30), lambda p: p["feature"].isin(list(modified)))) if modified else F.slice(ranked, 1, top)
    rows = records.select(id_col, F.size(pairs).alias("n_total"), best.alias("best"))
    return rows.select(id_col, F.size("best").alias("n_shown"), "n_total", F.explode("best").alias("b")).select(id_col, "b.feature", "b.phi", "n_shown", "n_total")
