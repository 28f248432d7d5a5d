"""The certification run: from a split cohort and a target pool to a report in three tiers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumlake import constants as C
from quorumlake.functions import heads, identifiers
from quorumlake.operators import betting, explain, shift, sites
from quorumlake.operators.splits import assert_disjoint, step_ranks


@dataclass
class Certificate:
    """head: the fitted head; modes: by alpha and mode, the certified thresholds, the deployed one, or why there is none;
    report: aggregates alone; answered: the target's records with whether they are answered, NULL head columns where the
    run declined before scoring."""

    report: dict
    modes: dict = field(default_factory=dict)
    head: heads.Head | None = None
    answered: DataFrame | None = None


def score(records: DataFrame, head: heads.Head) -> DataFrame:
    """records (x and, where known, y) with logit, p, pred, score and err."""
    out = records.withColumn("logit", head.logit(F.col("x")))
    out = out.withColumns(heads.scored(F.col("logit")))
    return out.withColumn("err", F.col("pred") != F.col("y")) if "y" in records.columns else out


def check_cohort(records: DataFrame) -> int:
    """The number of features. Raises ValueError on values that are not finite, unequal widths or a missing label."""
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    row = records.agg(F.count_if(F.coalesce(bad, F.lit(True))).alias("bad"), F.min(F.size("x")).alias("lo"), F.max(F.size("x")).alias("hi"), *([F.count_if(F.col("y").isNull()).alias("no_y")] if "y" in records.columns else [])).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} records have features that are not finite (reason=nonfinite-feature)")
    if row["lo"] != row["hi"]:
        raise ValueError("records have different numbers of features (reason=width-mismatch)")
    if "y" in records.columns and row["no_y"]:
        raise ValueError("a label is missing (reason=missing-label)")
    return row["hi"] or 0


def statement(alpha: float, mode: str) -> str:
    """What a certified rung says, in plain words."""
    ground = {"baseline": "target sites are exchangeable with the calibration sites", "bbse": "only the share of positives differs at the target"}[mode]
    return (
        f"If {ground}, then with confidence {1 - C.DELTA:.2f} the answered-set risk, averaged over sites with influence capped at {C.M_INFLUENCE} records, is at most {alpha}. "
        "Single sites may be above it, a batch's error count may be above it by chance, and nothing is said where the relation of features and outcome changes."
    )


def certify(cohort: DataFrame, target: DataFrame, *, alphas: tuple[float, ...] = C.ALPHA_LADDER, modes: tuple[str, ...] = ("baseline", "bbse"), oracle: str | None = None) -> Certificate:
    """Certifies thresholds of a head for a target pool.

    cohort: (site_label, split, y, x), split being train, aux or cal, by whole sites. target: (site_label, x), with the
    column `oracle` for diagnostics alone. Structural shortfalls are reports, misuse raises ValueError. Calibration
    records feed the walks and what follows from them, nothing else.
    """
    if not alphas or any(a not in C.ALPHA_LADDER for a in alphas):
        raise ValueError(f"alphas must be of {C.ALPHA_LADDER} (reason=bad-alpha)")
    if not modes or any(m not in ("baseline", "bbse") for m in modes):
        raise ValueError("modes must be of baseline, bbse (reason=bad-mode)")
    assert_disjoint(cohort)
    form = identifiers.collision_form
    fitted = cohort.where("split in ('train', 'aux')").select(form(F.col("site_label")).alias("s")).distinct()
    if not target.select(form(F.col("site_label")).alias("s")).distinct().join(fitted, "s", "left_semi").isEmpty():
        raise ValueError("a target site was fitted on (reason=target-in-fit)")
    if oracle is not None:
        if oracle not in target.columns or target.schema[oracle].dataType.simpleString() != "boolean":
            raise ValueError(f"{oracle!r} is no boolean column of the target (reason=bad-oracle)")
        if not target.where(F.col(oracle).isNull()).isEmpty():
            raise ValueError(f"{oracle!r} is not known for every target record (reason=bad-oracle)")
    if "record_id" in cohort.columns and "record_id" in target.columns and not target.join(cohort.select("record_id"), "record_id", "left_semi").isEmpty():
        raise ValueError("a target record is in the cohort (reason=record-overlap)")
    if check_cohort(cohort) != check_cohort(target.select("x")) and not target.isEmpty():
        raise ValueError("target and cohort differ in features (reason=width-mismatch)")
    classes = cohort.where("split = 'train'").agg(F.count_if("y"), F.count_if(~F.col("y"))).first()
    if not min(classes):
        raise ValueError("training records have one class (reason=single-class)")
    carrying = cohort.where("split = 'cal'").select("site_label").distinct().count()
    n_target = target.count()
    base = {"n_target": n_target, "n_cal_sites": carrying, "modes": list(modes)}
    for short, reason in ((carrying < C.MIN_CAL_CLUSTERS, "insufficient-clusters"), (n_target < C.MIN_ANSWERABLE, "insufficient-target")):
        if short:
            return Certificate({**base, "status": "declined", "reason": reason, "certified": {}, "estimated": None, "diagnostic": {}, "partition": {"answered": 0, "below_threshold": 0, "failsafe": 0, "structural": n_target, "unscorable": 0}})

    head = heads.fit_head(cohort.where("split = 'train'"))
    labelled = identifiers.dense_sites(cohort, "site_label") if "site_id" not in cohort.columns else cohort
    scored = score(labelled, head).select("site_id", "site_label", "split", "y", "pred", "err", "score").persist()
    sites.check_scores(scored)
    counts = {s: sites.threshold_counts(scored.where(F.col("split") == s)).persist() for s in ("aux", "cal")}
    pool = score(target, head)
    fit = shift.fit_shift(sites.class_rates(scored.where("split = 'aux'")), pool.select(F.col("site_label").alias("site_id"), "pred")) if "bbse" in modes else shift.ShiftFit(reason="not-run")

    of_cal = scored.where("split = 'cal'").select("site_id", "site_label").distinct()
    streams = [(a, m, e) for a in alphas for m, ends in ((C.MODE_BASELINE, ("",)), (C.MODE_BBSE, ("lo", "hi"))) for e in ends]
    orders = step_ranks(of_cal.select("site_label"), streams).join(of_cal, "site_label").persist()

    def ranks(alpha: float, mode_idx: int, stream: str) -> DataFrame:
        own = (F.col("alpha") == alpha) & (F.col("mode_idx") == mode_idx) & (F.col("stream") == stream)
        return orders.where(own).select("step", "site_id", "rank")

    results: dict = {}
    for alpha in alphas:
        for mode in modes:
            if mode == "bbse" and fit.declined:
                results[alpha, mode] = {"certified": [], "tau_idx": None, "tau": None, "reason": fit.reason}
                continue
            if mode == "baseline":
                order = sites.walk_order(sites.atoms(counts["aux"], alpha))
                walk = betting.walk(order, betting.bets(sites.atoms(counts["cal"], alpha), ranks(alpha, C.MODE_BASELINE, ""), alpha, C.DELTA, order=order))
            else:
                walk = shift.certify_shifted(counts["aux"], counts["cal"], fit, alpha, {e: ranks(alpha, C.MODE_BBSE, e) for e in ("lo", "hi")})
            prefix = walk.where("in_prefix").orderBy("step").collect()  # 23 rows at most
            best = next((r for r in prefix if r["deployed"]), None)
            results[alpha, mode] = {"certified": [r["tau_idx"] for r in prefix], "tau_idx": best and best["tau_idx"], "tau": best and best["tau"], "reason": None if best else "failsafe"}

    certified = {}
    for alpha in alphas:
        good = [(results[alpha, m]["tau"], -i, m) for i, m in enumerate(modes) if results[alpha, m]["tau"] is not None]
        if good:
            tau, _, mode = max(good)
            certified[alpha] = {"tau": tau, "tau_idx": results[alpha, mode]["tau_idx"], "mode": mode, "covering": sorted(m for _, _, m in good), "statement": statement(alpha, mode)}
    operative = min(certified) if certified else None
    report = {**base, "status": "certified" if certified else "declined", "reason": None if certified else "failsafe", "certified": certified, "operative_alpha": operative,
              "feasibility": {a: sites.feasibility(counts["aux"], a, carrying).first().asDict() for a in alphas}, "shift": fit.diagnostics, "shift_reason": fit.reason or None,
              "capped": sites.capped_share(counts["cal"].select("site_id", "n").distinct()).first().asDict()}
    # why a rung that is not certified is not, mode by mode
    report["reasons"] = {a: "|".join(f"{m}:{results[a, m]['reason']}" for m in modes) for a in alphas if a not in certified}
    tau = certified[operative]["tau"] if certified else None
    report["partition"] = betting.decline_partition(pool, tau).first().asDict()
    if certified:
        rung = certified[operative]
        rho = fit.rho_point if rung["mode"] == "bbse" else 1.0
        report["estimated"] = shift.estimate(counts["cal"], rung["tau_idx"], rho)
        told = explain.composition(pool, heads.answered(F.col("score"), tau), y=oracle, rho=rho).first().asDict()
        risk = sites.pool_risk(counts["cal"]).where(F.col("tau_idx") == rung["tau_idx"]).first().asDict()
        report["diagnostic"] = {"composition": told, "cal_risk": risk["risk"], "cal_coverage": risk["coverage"], "exceed": sites.exceedance(counts["cal"], operative).where(F.col("tau_idx") == rung["tau_idx"]).first().asDict()}
        pool = pool.withColumn("answered", heads.answered(F.col("score"), tau))
    else:
        report["estimated"], report["diagnostic"] = None, {}
        pool = pool.withColumn("answered", F.lit(False))
    for held in (scored, *counts.values(), orders):
        held.unpersist()
    return Certificate(report, results, head, pool)


def render(report: dict) -> str:
    """A report as text: the gate that stopped it, each rung, the estimate, coverage, and where the records went."""
    number = lambda v, digits: "-" if v is None or v != v else f"{v:.{digits}f}"
    lines = [f"status: {report['status']}"]
    if report.get("reason"):
        lines.append(f"  [gate] {report['reason']} ({report['n_cal_sites']} calibration sites with records)")
    reasons = report.get("reasons", {})
    for alpha in sorted({*report["certified"], *reasons}):
        if alpha in report["certified"]:
            rung = report["certified"][alpha]
            lines.append(f"  [certified] risk at most {alpha:.2f}: threshold {rung['tau']:.3f} by {rung['mode']} (modes {', '.join(rung['covering'])})")
        else:
            lines.append(f"  [declined] risk at most {alpha:.2f}: {reasons[alpha]}")
    if report.get("estimated"):
        e = report["estimated"]
        lines.append(f"  [estimated] answered-set risk {number(e['risk'], 4)} (95 % over resampled sites {number(e['ci'][0], 4)} to {number(e['ci'][1], 4)}, {e['n_boot']} draws)")
    told = report.get("diagnostic") or {}
    if told.get("cal_coverage") is not None:
        lines.append(f"  [diagnostic] calibration coverage {number(told['cal_coverage'], 2)}, risk {number(told['cal_risk'], 4)}, {report['n_cal_sites']} calibration sites")
    lines.append("  [partition] " + ", ".join(f"{k} {v}" for k, v in report["partition"].items()))
    return "\n".join(lines)


def stripped(certificate: Certificate, names: list[str], phi: str = "phi", top: int = 12) -> dict:
    """What of a certificate may leave: the report, how many records are answered, and the features behind abstention by name.

    Records become counts; of the abstention profile the first `top` features and their gaps stay.
    """
    report, pool = dict(certificate.report), certificate.answered
    if pool is not None and certificate.head is not None:
        report["n_answered"] = pool.where("answered").count()
        profile = explain.abstention_profile(pool.withColumn(phi, certificate.head.attribution(F.col("x"))), phi, F.col("answered"))
        first = profile.where(F.col("place") <= top).orderBy("place").collect()
        report["abstention"] = [{"feature": names[r["feature"]], "gap": round(r["gap"], 6)} for r in first]
    return report
