"""The certification run over many splits of the same sites at once: replicates, pools and rungs are columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake import constants as C
from quorumlake.functions import heads, intervals
from quorumlake.operators import betting, explain, ranks, shift, sites
from quorumlake.operators.splits import step_ranks

POOLED = "pooled"


@dataclass
class Replicated:
    """heads: by replicate. bins: (replicate, split, site_id, k, n, pos, bad_pos, bad). results: (replicate, pool, alpha,
    mode_idx, mode, tau_idx, tau, reason). walks: the baseline's steps, (replicate, alpha, step, tau_idx, tau, rejected,
    in_prefix, deployed). outcomes: a row for each replicate, pool and rung. fits: the shift of each pool, if that was run."""

    heads: dict
    bins: DataFrame
    walks: DataFrame
    results: DataFrame
    outcomes: DataFrame
    fits: DataFrame | None


def scored_bins(records: DataFrame, splits: DataFrame, fitted: dict[int, heads.Head], taus: list[float] = C.TAU_GRID) -> DataFrame:
    """(replicate, split, site_id, k, n, pos, bad_pos, bad): score_bins of every replicate's sites outside training, by its own head.

    A record is read once and scored by the heads of all replicates in which its site is not in training; what leaves a
    batch are counts.
    """
    kind = records.schema["site_id"].dataType.simpleString()
    held = splits.where("split <> 'train'").groupBy("site_id").agg(F.collect_list(F.col("replicate").cast("int")).alias("groups"))  # one entry a replicate
    rows = records.select("x", F.col("y").cast("boolean").alias("y"), "site_id").join(F.broadcast(held), "site_id").select("x", "y", "site_id", "groups")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        edges = np.array(taus)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            names, site = np.unique(batch.column(2).to_numpy(zero_copy_only=False), return_inverse=True)
            groups = batch.column(3)
            who, group = np.repeat(np.arange(batch.num_rows), groups.value_lengths().to_numpy()), groups.flatten().to_numpy()
            for g in np.unique(group).tolist():
                own, head = who[group == g], fitted[g]
                logit = ((x[own] - head.mu) / head.sd) @ np.array(head.coef) + head.intercept
                p = np.where(logit >= 0, 1 / (1 + np.exp(-np.abs(logit))), np.exp(-np.abs(logit)) / (1 + np.exp(-np.abs(logit))))
                wrong = (p >= 0.5) != y[own]
                reached = (np.maximum(p, 1 - p)[:, None] >= edges).sum(axis=1)
                code, at = np.unique(site[own] * (len(edges) + 1) + reached, return_inverse=True)
                count = lambda w: pa.array(np.bincount(at, w).astype(np.int64))  # noqa: E731, B023
                some = len(code)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(some, g, np.int32)), pa.array(names[code // (len(edges) + 1)]), pa.array((code % (len(edges) + 1)).astype(np.int32)),
                    count(np.ones(len(own))), count(y[own]), count(y[own] & wrong), count(wrong)], names=["replicate", "site_id", "k", "n", "pos", "bad_pos", "bad"])

    parts = rows.mapInArrow(run, f"replicate int, site_id {kind}, k int, n long, pos long, bad_pos long, bad long")
    summed = parts.groupBy("replicate", "site_id", "k").agg(*[F.sum(c).alias(c) for c in ("n", "pos", "bad_pos", "bad")])
    return summed.join(splits.select("replicate", "site_id", "split"), ["replicate", "site_id"])


def _deployed(walk: DataFrame, by: list[str], mode_idx: int, mode: str) -> DataFrame:
    """(by..., alpha, mode_idx, mode, tau_idx, tau, reason) of walks."""
    best = F.max(F.when(F.col("deployed"), F.struct("tau_idx", "tau")))
    got = walk.groupBy(*by, "alpha").agg(best.alias("b"))
    reason = F.when(F.col("b").isNull(), "failsafe")
    return got.select(*by, "alpha", F.lit(mode_idx).alias("mode_idx"), F.lit(mode).alias("mode"), F.col("b.tau_idx").alias("tau_idx"), F.col("b.tau").alias("tau"), reason.alias("reason"))


def run(records: DataFrame, splits: DataFrame, *, alphas: tuple[float, ...] = C.ALPHA_LADDER, modes: tuple[str, ...] = ("baseline", "bbse"), orders: DataFrame | None = None, fitted: dict | None = None) -> Replicated:
    """certify for every replicate of a table of splits, with the held-out target sites as one pool and each as a pool of its own.

    records: (site_id, y, x). splits: (replicate, site_id, split), split being train, aux, cal or target; every site has
    one split in a replicate. orders: (replicate, alpha, mode_idx, stream, step, site_id, rank) of calibration sites, by
    step_ranks unless given. fitted: heads by replicate, by fit_heads unless given.

    The number of jobs does not grow with that of replicates, pools or rungs: heads are fitted together, counts are kept
    by replicate and site, and orders, tests, walks and shift boxes are grouped relations. The baseline's walk serves all
    pools of a replicate, as it does not see the target. A pool of fewer records than can be answered, and all pools of
    a replicate with too few calibration sites, are declined for that.
    """
    if fitted is None:
        fitted = heads.fit_heads(records, splits.where("split = 'train'"))
    bins = scored_bins(records, splits, fitted).persist()
    keyed = lambda part, by: sites.counts_of_bins(bins.where(F.col("split") == part), by=["replicate"]).join(splits.where(F.col("split") == part).select("replicate", "site_id"), ["replicate", "site_id"])
    aux, cal, target = (keyed(part, "replicate").persist() for part in ("aux", "cal", "target"))
    rungs = F.explode(F.array(*[F.lit(float(a)) for a in alphas]))
    if orders is None:
        streams = [(a, m, e) for a in alphas for m, ends in ((C.MODE_BASELINE, ("",)), (C.MODE_BBSE, ("lo", "hi"))) for e in ends]
        orders = step_ranks(cal.select("replicate", "site_id").distinct(), streams, by=["replicate"], label="site_id").persist()
    by = ["replicate", "alpha"]
    order = sites.walk_order(sites.atoms(aux.withColumn("alpha", rungs), F.col("alpha"), by=by), by)
    own = orders.where((F.col("mode_idx") == C.MODE_BASELINE) & (F.col("stream") == ""))
    tests = betting.bets(sites.atoms(cal.withColumn("alpha", rungs), F.col("alpha"), by=by), own.select(*by, "step", "site_id", "rank"), F.col("alpha"), C.DELTA, by, order)
    walks = betting.walk(order, tests, by).persist()

    pools = target.select("replicate", "site_id").distinct().select("replicate", "site_id", F.explode(F.array(F.lit(POOLED), F.col("site_id").cast("string"))).alias("pool"))
    per_site = bins.where("split = 'target'").groupBy("replicate", "site_id").agg(F.sum("n").alias("n"), F.sum(F.col("pos") - F.col("bad_pos") + F.col("bad") - F.col("bad_pos")).alias("k"))
    members = pools.join(per_site, ["replicate", "site_id"])
    named = members.groupBy("replicate", "pool").agg(F.sum("n").alias("n_target"))
    results, fits = None, None
    if "baseline" in modes:
        results = named.select("replicate", "pool").join(_deployed(walks, ["replicate"], C.MODE_BASELINE, "baseline"), "replicate")
    if "bbse" in modes:
        rates = bins.where("split = 'aux'").groupBy("replicate", "site_id").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.sum(F.col("pos") - F.col("bad_pos")).alias("pred_pos"), F.sum(F.col("bad") - F.col("bad_pos")).alias("pred_neg"))
        fits = shift.fit_shifts(rates, members, by=["replicate"], pool=["pool"]).persist()
        by3 = ["replicate", "pool", "alpha"]
        good = fits.where("reason is null").select("replicate", "pool", "rho_lo", "rho_hi", "rho_point").withColumn("alpha", rungs)
        shifted = sites.walk_order(sites.atoms(aux.join(good, "replicate"), F.col("alpha"), rho=F.col("rho_point"), by=by3), by3)
        ends = good.select("replicate", "pool", "alpha", F.explode(F.array(*[F.struct(F.lit(e).alias("stream"), F.col(f"rho_{e}").alias("rho")) for e in ("lo", "hi")])).alias("e")).select(*by3, "e.*")
        by4 = [*by3, "stream"]
        both = betting.bets(
            sites.atoms(cal.join(ends, "replicate"), F.col("alpha"), rho=F.col("rho"), by=by4), orders.where(F.col("mode_idx") == C.MODE_BBSE).select("replicate", "alpha", "stream", "step", "site_id", "rank"),
            F.col("alpha"), C.BBSE_DELTA_BET, by4, shifted.join(ends.select(*by4), by3))
        passed = both.groupBy(*by3, "tau_idx", "tau").agg(F.bool_and("rejected").alias("rejected"))
        walked = _deployed(betting.walk(shifted, passed, by3), ["replicate", "pool"], C.MODE_BBSE, "bbse")
        declined = fits.where("reason is not null").withColumn("alpha", rungs).select("replicate", "pool", "alpha", F.lit(C.MODE_BBSE).alias("mode_idx"), F.lit("bbse").alias("mode"), F.lit(None).cast("int").alias("tau_idx"), F.lit(None).cast("double").alias("tau"), "reason")
        results = walked.unionByName(declined) if results is None else results.unionByName(walked).unionByName(declined)

    carrying = cal.groupBy("replicate").agg(F.count_distinct("site_id").alias("n_cal_sites"))
    short = F.when(F.col("n_cal_sites") < C.MIN_CAL_CLUSTERS, "insufficient-clusters").when(F.col("n_target") < C.MIN_ANSWERABLE, "insufficient-target")
    named = named.join(carrying, "replicate").withColumn("short", short)
    results = results.join(named.select("replicate", "pool", "short"), ["replicate", "pool"])
    off = F.col("short").isNotNull()
    results = results.select("replicate", "pool", "alpha", "mode_idx", "mode", *[F.when(~off, F.col(c)).alias(c) for c in ("tau_idx", "tau")], F.coalesce("short", "reason").alias("reason")).persist()
    rung = betting.combine_modes(results, ["replicate", "pool"])
    return Replicated(fitted, bins, walks, results, evaluate(rung, target, pools, named), fits)


def evaluate(rungs: DataFrame, counts: DataFrame, pools: DataFrame, named: DataFrame) -> DataFrame:
    """A row for each replicate, pool and rung: what the deployed threshold then does to the pool's records.

    rungs: (replicate, pool, alpha, tau, mode, covering, declined); counts: of target sites; pools: (replicate, site_id,
    pool); named: (replicate, pool, n_target, n_cal_sites). risk: that of the answered set with influence capped; hard:
    whether the lower 95 % bound of the plain error rate is over alpha. NULLs where nothing is certified or answered.
    """
    g = sites.influence()
    wrong, answered = F.col("err_pos") + F.col("err_neg"), F.col("ans_pos") + F.col("ans_neg")
    over = wrong.cast("double") / F.when(answered > 0, answered) > F.col("alpha")
    placed = rungs.where("tau is not null").select("replicate", "pool", "alpha", "tau").join(pools, ["replicate", "pool"]).join(counts, ["replicate", "site_id", "tau"])
    got = placed.groupBy("replicate", "pool", "alpha").agg(
        F.sum(answered).alias("n_answered"), F.sum(wrong).alias("n_wrong"), F.try_divide(F.sum(g * wrong), F.sum(g * answered)).alias("risk"),
        F.avg(F.when(answered > 0, over.cast("double"))).alias("exceed_share"))
    out = rungs.join(named, ["replicate", "pool"]).join(got, ["replicate", "pool", "alpha"], "left")
    rate = F.try_divide(F.col("n_wrong").cast("double"), F.col("n_answered"))
    return out.select(
        "replicate", "pool", "alpha", F.col("tau").isNotNull().alias("certified"), "tau", "mode", "covering", "declined", "n_target", "n_cal_sites", "n_answered",
        F.try_divide(F.col("n_answered").cast("double"), F.col("n_target")).alias("coverage"), rate.alias("error_rate"), "risk", (F.col("risk") > F.col("alpha")).alias("risk_exceeds"),
        "exceed_share", (intervals.wilson_lower(F.col("n_wrong"), F.col("n_answered")) > F.col("alpha")).alias("hard"))


def summary(outcomes: DataFrame, pooled: bool = True) -> DataFrame:
    """(alpha, replicates, certify_rate, mean_tau, mean_coverage, mean_risk, exceed_rate, hard_rate) of pooled or single-site pools.

    Means and rates are over what was certified and answered, NULL where nothing was.
    """
    rows = outcomes.where((F.col("pool") == POOLED) if pooled else (F.col("pool") != POOLED))
    share = lambda c: F.avg(F.when(F.col("certified"), F.col(c).cast("double")))
    return rows.groupBy("alpha").agg(
        F.count("*").alias("rows"), F.count_distinct("replicate").alias("replicates"), F.avg(F.col("certified").cast("double")).alias("certify_rate"), F.avg("tau").alias("mean_tau"),
        share("coverage").alias("mean_coverage"), share("risk").alias("mean_risk"), share("risk_exceeds").alias("exceed_rate"), share("hard").alias("hard_rate"))


def logit_by_replicate(of: dict[int, heads.Head], places: list[int]) -> Column:
    """The logit of the features at these places by the head of the row's replicate; heads are a literal map in the features' own units."""
    rows = {g: [*[c / s for c, s in zip(h.coef, h.sd, strict=True)], h.intercept - sum(c * m / s for c, m, s in zip(h.coef, h.mu, h.sd, strict=True))] for g, h in of.items()}
    own = F.create_map(*[v for g, w in rows.items() for v in (F.lit(g), F.array(*[F.lit(float(c)) for c in w]))])[F.col("replicate")]
    return sum((F.get("x", F.lit(j)) * F.get(own, F.lit(i)) for i, j in enumerate(places)), F.get(own, F.lit(len(places))))


def comparators(records: DataFrame, splits: DataFrame, got: Replicated, rival: str = "comparator") -> DataFrame:
    """(replicate, alpha, n, n_available, available_share, brier, subset_error, auc): a rival's probability on what each pooled rung answers.

    records: (site_id, y, x, rival), the rival NULL where it has none. subset_error: how often the replicate's own head
    is wrong on the answered records that have a rival.
    """
    rungs = got.outcomes.where(F.col("certified") & (F.col("pool") == POOLED)).select("replicate", "alpha", "tau")
    width = len(next(iter(got.heads.values())).coef)
    rows = records.join(F.broadcast(splits.where("split = 'target'").select("replicate", "site_id")), "site_id").select("replicate", "y", rival, logit_by_replicate(got.heads, list(range(width))).alias("logit"))
    answered = rows.withColumns(heads.scored(F.col("logit"))).join(F.broadcast(rungs), "replicate").where(F.col("score") >= F.col("tau"))
    return explain.comparator(answered.withColumn("err", F.col("pred") != F.col("y")), rival, by=["replicate", "alpha"], err="err")


def leak_probe(records: DataFrame, splits: DataFrame, hidden: list[int], *, fitted: dict | None = None) -> DataFrame:
    """(replicate, auc, auc_ablated, ablation_drop, auc_alarm, ablation_alarm): leak_alarm of every replicate on its calibration sites.

    hidden: places of the features that the ablated heads do without. Both heads of all replicates are fitted together
    and judged out of sample; see ranks.leak_alarm for the alarms.
    """
    keep = [j for j in range(len(records.select("x").first()[0])) if j not in hidden]
    train, cal = splits.where("split = 'train'"), splits.where("split = 'cal'").select("replicate", "site_id")
    fitted = fitted or heads.fit_heads(records, train)
    ablated = heads.fit_heads(records.withColumn("x", F.array(*[F.get("x", F.lit(j)) for j in keep])), train)
    every = list(range(len(keep) + len(hidden)))
    scored = records.join(F.broadcast(cal), "site_id").select("replicate", "y", logit_by_replicate(fitted, every).alias("full"), logit_by_replicate(ablated, keep).alias("without"))
    return ranks.leak_alarm(scored, "full", "without", "y", by=["replicate"])
