"""Label-shift correction: a confidence box on the odds ratio of the positive class, and certification at its ends.

Resampling runs over per-site sufficient statistics, as relations: draws, sites and pools are rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake import constants as C
from quorumlake.functions.intervals import clopper_pearson_ends, odds_ratio_ends, odds_ratio_of

from . import betting, sites
from .resampling import bootstrap, resampled

#: The keys of a fit's diagnostics; what a fit did not get to is None.
DIAGNOSTICS = ("n_target", "n_target_sites", "min_target_sites", "q_target", "q_ci", "c0", "c1", "pi_s", "c0_ci", "c1_ci", "pi_s_ci", "gap_lo", "n_boot", "n_attempts", "rho_lo", "rho_hi", "rho_point")


@dataclass
class ShiftFit:
    """A fitted correction, or the reason for declining it."""

    reason: str = ""
    rho_lo: float = math.nan
    rho_hi: float = math.nan
    rho_point: float = math.nan
    diagnostics: dict = field(default_factory=lambda: dict.fromkeys(DIAGNOSTICS))

    @property
    def declined(self) -> bool:
        return bool(self.reason)


def stream_of(*stream: int | str):
    """The random stream of a name; text parts of it enter by their SHA-256."""
    import hashlib

    import numpy as np

    seed = [C.SEED]
    for part in stream:
        if isinstance(part, str):
            digest = hashlib.sha256(part.encode()).digest()
            seed += [int.from_bytes(digest[:4], "big"), int.from_bytes(digest[4:8], "big")]
        else:
            seed.append(int(part))
    return np.random.default_rng(np.random.SeedSequence(seed))


def permutation(n: int, *stream: int | str) -> list[int]:
    """Ranks of n sites in a fixed stream."""
    return stream_of(*stream).permutation(n).tolist()


def permutations(times: int, n: int, *stream: int | str) -> list[list[int]]:
    """Ranks of n sites in one order after another of a fixed stream."""
    import numpy as np

    rng = stream_of(*stream)
    return [np.argsort(rng.permutation(n), kind="stable").tolist() for _ in range(times)]


def fit_shifts(aux_rates: DataFrame, targets: DataFrame, *, by: list[str] = (), pool: list[str] = (), seed: int = C.SEED) -> DataFrame:
    """A row for each pool: (by..., pool..., reason, n_target, n_target_sites, q_target, q_lo, q_hi, c0, c1, pi_s, their _lo and _hi, gap_lo, n_boot, n_attempts, rho_lo, rho_hi, rho_point).

    aux_rates: (by..., site_id, n, pos, pred_pos, pred_neg), what sites.class_rates gives. targets: (by..., pool...,
    site_id, n, k), records and predicted positives of each site of a pool. All groups and pools are fitted in one plan:
    sites are resampled as relations (see resampling), the error rates once for each group of `by`. Declines, in this
    order: 2 to 9 target sites; too few draws with both classes; error rates too close; a target rate outside what the
    error rates can give. reason is NULL where a fit is not declined; what a fit did not get to is NULL.
    """
    by, keys = list(by), [*by, *pool]
    level = C.BBSE_DELTA_CONF / C.BBSE_BONFERRONI
    low, high = level / 2, 1 - level / 2
    rates = lambda n, pos, hit, false: {"c0": false / (n - pos), "c1": hit / pos, "pi_s": pos / n}
    cols = ["n", "pos", "pred_pos", "pred_neg"]
    both = (F.col("pos") >= 1) & (F.col("n") - F.col("pos") >= 1)
    measures = rates(*[F.when(both, F.col(c).cast("double")) for c in cols])
    draws = resampled(aux_rates, cols, draws=C.BBSE_BOOT_MAX_ATTEMPTS, seed=seed, stream="aux", by=by)
    box = bootstrap(draws, both, measures, wanted=C.BBSE_BOOT, most=C.BBSE_BOOT_MAX_ATTEMPTS, low=low, high=high, by=by)
    point = aux_rates.groupBy(*by).agg(*[F.sum(c).alias(c) for c in cols]).select(*by, *[m.alias(k) for k, m in measures.items()])
    pools = targets.groupBy(*keys).agg(F.sum("n").alias("n_target"), F.sum("k").alias("k"), F.count("*").alias("n_target_sites")).withColumn("q_target", F.try_divide(F.col("k").cast("double"), F.col("n_target")))
    q_draws = resampled(targets, ["n", "k"], draws=C.BBSE_BOOT, seed=seed, stream="target", by=keys)
    q_box = bootstrap(q_draws, F.col("n") > 0, {"q": F.try_divide(F.col("k").cast("double"), F.col("n"))}, wanted=C.BBSE_BOOT, most=C.BBSE_BOOT, low=low, high=high, by=keys).select(*keys, "q_lo", "q_hi")
    exact = clopper_pearson_ends(F.col("k"), F.col("n_target"), level)

    def beside(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return left.join(right, on, "left") if on else left.crossJoin(right)  # without keys both have one row

    got = beside(beside(beside(pools, q_box, keys), point, by), box, by)
    single = F.col("n_target_sites") <= 1
    got = got.withColumn("_exact", F.when(single, exact))
    got = got.withColumns({e: F.when(single, F.col("_exact")[e[2:]]).otherwise(F.col(e)) for e in ("q_lo", "q_hi")}).withColumn("gap_lo", F.col("c1_lo") - F.col("c0_hi"))
    reason = (
        F.when(F.col("n_target") == 0, "bbse-empty-target").when((F.col("n_target_sites") >= 2) & (F.col("n_target_sites") < C.BBSE_MIN_TARGET_SITES), "bbse-target-clustering")
        .when(F.col("c0").isNull() | (F.coalesce(F.col("n_boot"), F.lit(0)) < C.BBSE_BOOT), "bbse-degenerate-bootstrap").when(F.col("gap_lo") < C.BBSE_GAP_FLOOR, "bbse-ill-conditioned")
        .when(~((F.col("c0_lo") <= F.col("q_lo")) & (F.col("q_hi") <= F.col("c1_hi"))), "bbse-misspecified")
    )
    ends = odds_ratio_ends(*[(F.col(f"{k}_lo"), F.col(f"{k}_hi")) for k in ("q", "c0", "c1", "pi_s")])
    fine = F.col("reason").isNull()
    got = got.withColumn("reason", reason).withColumns({
        "rho_lo": F.when(fine, ends[0]), "rho_hi": F.when(fine, ends[1]), "rho_point": F.when(fine, odds_ratio_of(*[F.col(c) for c in ("q_target", "c0", "c1", "pi_s")]))})
    return got.select(*keys, "reason", *SHIFT_COLUMNS)


#: The columns of a fitted shift beside its keys and its reason.
SHIFT_COLUMNS = ("n_target", "n_target_sites", "q_target", "q_lo", "q_hi", "c0", "c1", "pi_s", "c0_lo", "c0_hi", "c1_lo", "c1_hi", "pi_s_lo", "pi_s_hi", "gap_lo", "n_boot", "n_attempts", "rho_lo", "rho_hi", "rho_point")


def fit_shift(aux_rates: DataFrame, target: DataFrame, seed: int = C.SEED) -> ShiftFit:
    """The fit of one pool, by fit_shifts. target: (site_id, pred); a constant or NULL site_id declares one site."""
    per = target.groupBy("site_id").agg(F.count("*").alias("n"), F.count_if("pred").alias("k"))
    row = fit_shifts(aux_rates, per, seed=seed).first()
    out = ShiftFit()
    d = out.diagnostics
    if row is None or not row["n_target"]:
        d["n_target"], out.reason = 0, "bbse-empty-target"
        return out
    out.reason = row["reason"] or ""
    d.update(n_target=row["n_target"], n_target_sites=row["n_target_sites"], q_target=row["q_target"])
    if out.reason == "bbse-target-clustering":
        d["min_target_sites"] = C.BBSE_MIN_TARGET_SITES
        return out
    d.update(n_boot=row["n_boot"] or 0, n_attempts=row["n_attempts"] or 0)
    if out.reason == "bbse-degenerate-bootstrap":
        return out
    d.update({f"{k}_ci": (row[f"{k}_lo"], row[f"{k}_hi"]) for k in ("q", "c0", "c1", "pi_s")}, **{k: row[k] for k in ("c0", "c1", "pi_s", "gap_lo")})
    if not out.reason:
        out.rho_lo, out.rho_hi, out.rho_point = row["rho_lo"], row["rho_hi"], row["rho_point"]
        d.update(rho_lo=out.rho_lo, rho_hi=out.rho_hi, rho_point=out.rho_point)
    return out


def certify_shifted(aux_counts: DataFrame, cal_counts: DataFrame, fit: ShiftFit, alpha: float, ranks: dict[str, DataFrame]) -> DataFrame:
    """The walk of a rung under label shift: a threshold passes if the tests at both ends of the box reject it.

    aux_counts, cal_counts: what sites.threshold_counts gives. The order is that of auxiliary atoms at the point ratio.
    ranks: (step, site_id, rank) for 'lo' and 'hi'.
    """
    order = sites.walk_order(sites.atoms(aux_counts, alpha, rho=fit.rho_point))
    tests = None
    for name, rho in (("lo", fit.rho_lo), ("hi", fit.rho_hi)):
        one = betting.bets(sites.atoms(cal_counts, alpha, rho=rho), ranks[name], alpha, C.BBSE_DELTA_BET, order=order)
        tests = one if tests is None else tests.unionByName(one)
    both = tests.groupBy("tau_idx", "tau").agg(F.bool_and("rejected").alias("rejected"))
    return betting.walk(order, both)


def estimates(counts: DataFrame, *, by: list[str] = (), rho: Column | float = 1.0, seed: int = C.SEED) -> DataFrame:
    """(by..., risk, ci_lo, ci_hi, n_boot, n_attempts): answered risk with a 95 % percentile interval over resampled sites.

    counts: (by..., site_id, ans_pos, ans_neg, err_pos, err_neg), one row for each site of a group. Draws that answer
    nothing are topped up; the ends are NULL where that does not suffice, the risk is NULL where nothing is answered.
    """
    r = rho if isinstance(rho, Column) else F.lit(float(rho))
    sums = counts.select(*by, "site_id", (F.col("err_pos") * r + F.col("err_neg")).alias("wrong"), (F.col("ans_pos") * r + F.col("ans_neg")).alias("answered"))
    risk = F.try_divide(F.col("wrong"), F.col("answered"))
    draws = resampled(sums, ["wrong", "answered"], draws=C.ESTIMATE_BOOT_MAX_ATTEMPTS, seed=seed, stream="estimate", by=by)
    box = bootstrap(draws, F.col("answered") > 0, {"ci": risk}, wanted=C.ESTIMATE_BOOT, most=C.ESTIMATE_BOOT_MAX_ATTEMPTS, low=0.025, high=0.975, by=by)
    point = sums.groupBy(*by).agg(F.try_divide(F.sum("wrong"), F.sum("answered")).alias("risk"))
    both = point.join(box, list(by), "left") if by else point.crossJoin(box)  # without groups both have one row
    return both.select(*by, "risk", "ci_lo", "ci_hi", "n_boot", "n_attempts")


def estimate(counts: DataFrame, tau_idx: int, rho: float = 1.0, seed: int = C.SEED) -> dict:
    """The estimate at one threshold, by estimates; NaN bounds where too few samples answer anything."""
    row = estimates(counts.where(F.col("tau_idx") == tau_idx), rho=rho, seed=seed).first()
    end = lambda v: math.nan if v is None else v
    return {"risk": row and row["risk"], "ci": (end(row and row["ci_lo"]), end(row and row["ci_hi"])), "n_boot": row["n_boot"] if row else 0}
