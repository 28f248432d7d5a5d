"""A linear scoring head and what follows from it exactly, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake import constants as C


def sigmoid(z: Column) -> Column:
    """1 / (1 + exp(-z)) without overflow."""
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


@dataclass(frozen=True)
class Head:
    """Coefficients over standardised features; of as many numbers as there are features."""

    coef: tuple[float, ...]
    intercept: float
    mu: tuple[float, ...]
    sd: tuple[float, ...]

    def z(self, x: Column) -> Column:
        """Standardised features of an array column."""
        pairs = F.arrays_zip(x.alias("x"), self._array(self.mu).alias("m"), self._array(self.sd).alias("s"))
        return F.transform(pairs, lambda p: (p["x"] - p["m"]) / p["s"])

    @staticmethod
    def _array(values: tuple[float, ...]) -> Column:
        return F.array(*[F.lit(float(v)) for v in values])

    def attribution(self, x: Column) -> Column:
        """Exact additive shares of the logit, one for each feature."""
        return F.zip_with(self.z(x), self._array(self.coef), lambda a, b: a * b)

    def logit(self, x: Column) -> Column:
        return F.aggregate(self.attribution(x), F.lit(float(self.intercept)), lambda s, v: s + v)

    def importance(self) -> list[tuple[int, float]]:
        """(feature, |coefficient|), largest first, ties by feature."""
        return sorted(((j, abs(c)) for j, c in enumerate(self.coef)), key=lambda t: (-t[1], t[0]))


def scored(logit: Column) -> dict[str, Column]:
    """p, the hard label (p of at least a half) and the confidence of the answer."""
    p = sigmoid(logit)
    return {"p": p, "pred": p >= 0.5, "score": F.greatest(p, 1.0 - p)}


def answered(score: Column, tau: float) -> Column:
    """Whether a record is answered; ties are."""
    return score >= F.lit(tau)


def abstention(logit: Column, phi: Column, tau: float) -> dict[str, Column]:
    """What keeps a record from being answered: the logit it would need, the margin, and shares signed by its answer."""
    need = math.log(tau / (1.0 - tau))
    sign = F.when(logit >= 0, 1.0).otherwise(-1.0)
    return {
        "needed_logit": F.lit(need), "margin": F.lit(need) - F.abs(logit), "declined": ~answered(scored(logit)["score"], tau),
        "signed_phi": F.transform(phi, lambda v: v * sign),
    }


def counterfactual(head: Head, x: Column, logit: Column, tau: float) -> dict[str, Column]:
    """Closed-form moves, in standard deviations, after which a declined record is answered with the same label.

    cf_move: the smallest move over all features together; cf_single: for each feature the move of it alone, NULL for
    features without weight; cf_best: the feature of the smallest such move, the first among equals; cf_answered:
    whether the deployed rule answers the record after cf_move. Answered records need no move.
    """
    need = math.log(tau / (1.0 - tau)) + C.LOGIT_HEADROOM
    sign = F.when(logit >= 0, 1.0).otherwise(-1.0)
    gap = F.greatest(F.lit(need) - F.abs(logit), F.lit(0.0)) * sign
    square = sum(c * c for c in head.coef)
    move = F.transform(Head._array(head.coef), lambda c: gap * c / square) if square else F.transform(x, lambda v: F.lit(None).cast("double"))
    single = F.transform(Head._array(head.coef), lambda c: F.when(c != 0, gap / F.when(c != 0, c)))
    order = F.array_sort(F.filter(F.transform(single, lambda v, j: F.struct(F.abs(v).alias("a"), j.alias("j"))), lambda s: s["a"].isNotNull()))
    moved = F.aggregate(F.zip_with(move, Head._array(head.coef), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + logit
    return {"cf_gap": gap, "cf_move": move, "cf_single": single, "cf_best": F.get(order, F.lit(0))["j"], "cf_answered": answered(scored(moved)["score"], tau)}



def _literals(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _once(value: Column, body) -> Column:
    """body(value), the value being worked out once for a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ranked_moves(head: Head, x: Column, logit: Column, tau: float) -> dict[str, Column]:
    """All closed-form moves that bring a declined record to an answer of the same label, and what the deployed rule then says.

    cf_declined; cf_distance: length of the shortest move over all features together, in standard deviations, infinite
    for a head without weights; cf_opposite: that to an answer of the other label; cf_moves: (feature, dz, dx) of every
    feature that can do it alone, the smallest move first, ties by feature, none for an answered record. The gap is one
    factor of all moves, so their order is that of the weights and the same for every record; features without weight
    would have to move without end and are left out. cf_flips: whether the rule answers the record after the shortest
    move, worked out anew from its features; cf_confidence, cf_class: what it then says, NULL where it does not.
    """
    bar = math.log(tau / (1.0 - tau))
    sign = F.when(logit >= 0, 1.0).otherwise(-1.0)
    margin = F.lit(bar) - F.abs(logit)
    declined = margin > 0
    gap = F.when(declined, (margin + C.LOGIT_HEADROOM) * sign).otherwise(F.lit(0.0))
    norm = math.sqrt(sum(c * c for c in head.coef))
    endless = F.lit(float("inf"))
    order = [j for j, _ in sorted(((j, -abs(c)) for j, c in enumerate(head.coef) if c != 0.0), key=lambda t: (t[1], t[0]))]
    each = [F.struct(F.lit(j).alias("feature"), (gap / head.coef[j]).alias("dz"), (gap / head.coef[j] * head.sd[j]).alias("dx")) for j in order]
    none = F.array().cast("array<struct<feature:int,dz:double,dx:double>>")
    step = _literals([float(c * s / (norm * norm)) if norm else 0.0 for c, s in zip(head.coef, head.sd, strict=True)])
    moved = head.logit(F.zip_with(x, step, lambda v, m: v + gap * m))
    after = scored(moved)
    flips = answered(after["score"], tau)
    fine = declined & flips
    return {
        "cf_declined": declined, "cf_distance": F.greatest(margin, F.lit(0.0)) / norm if norm else F.when(declined, endless).otherwise(F.lit(0.0)),
        "cf_opposite": (F.lit(bar) + F.abs(logit)) / norm if norm else endless, "cf_moves": F.when(declined, F.array(*each)).otherwise(none) if each else none,
        "cf_flips": flips, "cf_confidence": F.when(fine, after["score"]), "cf_class": F.when(fine, sign > 0),
    }


def moved_alone(head: Head, x: Column, feature: Column, dz: Column) -> Column:
    """The logit after one feature of a record moves by dz standard deviations, worked out anew from its features."""
    sd = F.get(_literals([float(s) for s in head.sd]), feature)
    return head.logit(F.transform(x, lambda v, j: F.when(j == feature, v + dz * sd).otherwise(v)))


def crossings(head: Head, x: Column, logit: Column, tau: float) -> Column:
    """Array of (feature, z_now, z_no, z_yes, x_no, x_yes): where a feature alone brings a record to the bar of an answer.

    z_no, z_yes: the values, in standard deviations from the mean, at which the record's score is the threshold with the
    negative and with the positive label; between them it is declined. NULLs for features without weight.
    """
    bar, phi, z = math.log(tau / (1.0 - tau)), head.attribution(x), head.z(x)
    own = []
    for j, c in enumerate(head.coef):
        base = logit - F.get(phi, F.lit(j))
        at = {e: (F.lit(b) - base) / c if c != 0.0 else F.lit(None).cast("double") for e, b in (("no", -bar), ("yes", bar))}
        own.append(F.struct(F.lit(j).alias("feature"), F.get(z, F.lit(j)).alias("z_now"), *[at[e].alias(f"z_{e}") for e in at], *[(at[e] * head.sd[j] + head.mu[j]).alias(f"x_{e}") for e in at]))
    return F.array(*own)


def level_table(head: Head, x: Column, logit: Column, tau: float, members: list[int]) -> Column:
    """Array of (level, now, p, answered): a record under each level of a one-hot group; all its members move together.

    members: places of the group's features; the level's own is 1, the others are 0. now: whether the record has it.
    """
    phi = head.attribution(x)
    rest = _once(phi, lambda own: logit - sum(F.get(own, F.lit(j)) for j in members))
    off = {j: head.coef[j] * (0.0 - head.mu[j]) / head.sd[j] for j in members}
    parts = [sum(off[k] for k in members if k != j) + head.coef[j] * (1.0 - head.mu[j]) / head.sd[j] for j in members]
    moves = F.array(*[F.struct(F.lit(j).alias("level"), F.lit(float(v)).alias("part")) for j, v in zip(members, parts, strict=True)])

    def told(m: Column, r: Column) -> Column:
        after = scored(r + m["part"])
        return F.struct(m["level"].alias("level"), (F.get(x, m["level"]) == 1.0).alias("now"), after["p"].alias("p"), answered(after["score"], tau).alias("answered"))

    return _once(rest, lambda r: F.transform(moves, lambda m: told(m, r)))


def state_table(head: Head, x: Column, logit: Column, tau: float, features: list[int]) -> Column:
    """Array of (feature, state, now, p, answered): a record with each of the given 0/1 features at either state."""
    phi, own = head.attribution(x), []
    for j in features:
        for state in (0.0, 1.0):
            after = scored(logit - F.get(phi, F.lit(j)) + head.coef[j] * (state - head.mu[j]) / head.sd[j])
            own.append(F.struct(F.lit(j).alias("feature"), F.lit(int(state)).alias("state"), (F.get(x, F.lit(j)) == state).alias("now"), after["p"].alias("p"), answered(after["score"], tau).alias("answered")))
    return F.array(*own)


def response(head: Head, x: Column, logit: Column, feature: int, *, points: int = 161, reach: float = 4.0) -> Column:
    """Array of (step, z, p): a record's probability as one feature alone goes from -reach to reach standard deviations."""
    return response_from(head, logit - F.get(head.attribution(x), F.lit(feature)), feature, points=points, reach=reach)


def response_from(head: Head, base: Column, feature: int, *, points: int = 161, reach: float = 4.0) -> Column:
    """response of a record whose logit without the feature's share is base: all that the curve depends on."""
    grid = F.sequence(F.lit(0), F.lit(points - 1))
    z = lambda i: F.lit(-reach) + F.lit(2.0 * reach) * i / (points - 1)
    return _once(base, lambda b: F.transform(grid, lambda i: F.struct(i.alias("step"), z(i).alias("z"), sigmoid(b + head.coef[feature] * z(i)).alias("p"))))


def fit_head(records: DataFrame, x_col: str = "x", y_col: str = "y") -> Head:
    """An L2-regularised logistic head (C = 1, unpenalised intercept) on standardised features, fitted on the cluster.

    Features whose standard deviation is nothing beside their mean are divided by 1.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n = len(records.select(x_col).first()[0])
    stats = records.agg(F.count("*").alias("n"), *[f(F.get(x_col, F.lit(j))).alias(f"{k}{j}") for j in range(n) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mu = tuple(stats[f"m{j}"] for j in range(n))
    sd = tuple(s if s > C.SD_REL_TOL * max(1.0, abs(m)) else 1.0 for m, s in zip(mu, (stats[f"s{j}"] for j in range(n)), strict=True))
    blank = Head((0.0,) * n, 0.0, mu, sd)
    rows = records.select(array_to_vector(blank.z(F.col(x_col))).alias("features"), F.col(y_col).cast("double").alias("label"))
    lr = LogisticRegression(regParam=1.0 / (C.HEAD_C * stats["n"]), elasticNetParam=0.0, standardization=False, maxIter=C.HEAD_MAX_ITER, tol=1e-10)
    model = lr.fit(rows)
    return Head(tuple(model.coefficients.toArray().tolist()), float(model.intercept), mu, sd)


def packed(rows: DataFrame) -> DataFrame:
    """(x, y, sizes, groups): rows (x, y, groups) in blocks of a few thousand, as the bytes of numbers.

    groups: the array of the groups that a record is in; sizes: how many they are. Rounds read blocks instead of turning
    each record into Arrow anew.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                x, y, groups = batch.column(0).flatten(), batch.column(1), batch.column(2)
                parts = [(x, "f8"), (y, "f8"), (groups.value_lengths(), "i4"), (groups.flatten(), "i4")]
                yield pa.RecordBatch.from_arrays([pa.array([v.to_numpy(zero_copy_only=False).astype(k).tobytes()], pa.binary()) for v, k in parts], names=["x", "y", "sizes", "groups"])

    known = rows.select("x", F.col("y").cast("boolean").alias("y"), "groups")
    return known.mapInArrow(run, "x binary, y binary, sizes binary, groups binary")


def grouped_sums(rows: DataFrame, of, size: int) -> dict:
    """Sums by group of of(x, y, group), an array of `size` numbers for the records of a batch that belong to the group.

    rows: blocks of records, from packed. A record is read once for all its groups; a task passes on one vector a group.
    """
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total: dict = {}
        for batch in batches:
            for block in zip(*batch.columns, strict=True):
                x, y, sizes, group = (np.frombuffer(v.as_buffer(), kind) for v, kind in zip(block, ("f8", "f8", "i4", "i4"), strict=True))
                x, who = x.reshape(len(y), -1), np.repeat(np.arange(len(y)), sizes)
                for g in np.unique(group).tolist():
                    own = who[group == g]
                    total[g] = total.get(g, 0.0) + np.asarray(of(x[own], y[own], g), float)
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[k] for k in keys], pa.list_(pa.float64()))], names=["g", "part"])

    parts = rows.mapInArrow(run, "g int, part array<double>")
    found = parts.select("g", array_to_vector("part").alias("part")).groupBy("g").agg(Summarizer.sum(F.col("part")).alias("s")).collect()  # one row a group
    return {r["g"]: r["s"].toArray() for r in found}


def fit_heads(records: DataFrame, members: DataFrame, *, by: str = "replicate", site: str = "site_id", tolerance: float = 1e-10, most_rounds: int = 100) -> dict[int, Head]:
    """fit_head for many groups at once: a head for each value of `by` in members (by, site), fitted on the records of its sites.

    Newton's steps of all heads are made together: a round is one pass over the records, which sums loss, gradient and
    Gram matrix of every head, so the number of jobs does not grow with that of heads. A step after which a head's loss
    is higher is halved. The driver holds (features + 1)^2 numbers for each head. Raises ValueError where a group's
    records have one class, RuntimeError where a head is not fitted after most_rounds.
    """
    groups = members.groupBy(site).agg(F.collect_list(F.col(by).cast("int")).alias("groups"))  # one entry for each group
    rows = packed(records.select(site, F.col("x").cast("array<double>").alias("x"), "y").join(F.broadcast(groups), site)).persist()  # read once a round
    try:
        first = records.select("x").first()
        return _fit_groups(rows, len(first[0]) if first else 0, tolerance, most_rounds)
    finally:
        rows.unpersist()


def _fit_groups(rows: DataFrame, width: int, tolerance: float, most_rounds: int) -> dict[int, Head]:
    import numpy as np

    sums = grouped_sums(rows, lambda x, y, g: [len(y), y.sum(), *x.sum(axis=0)], width + 2)
    if not sums or any(not 0 < s[1] < s[0] for s in sums.values()):
        raise ValueError("training records have one class (reason=single-class)")
    keys = sorted(sums)
    n, mu = {g: sums[g][0] for g in keys}, {g: sums[g][2:] / sums[g][0] for g in keys}
    spread = grouped_sums(rows, lambda x, y, g: ((x - mu[g]) ** 2).sum(axis=0), width)
    sd = {g: np.sqrt(spread[g] / n[g]) for g in keys}
    sd = {g: np.where(sd[g] > C.SD_REL_TOL * np.maximum(1.0, np.abs(mu[g])), sd[g], 1.0) for g in keys}
    penalty = np.append(np.full(width, 1.0 / C.HEAD_C), 0.0)
    at, step, loss, open_ = {g: np.zeros(width + 1) for g in keys}, {g: np.zeros(width + 1) for g in keys}, dict.fromkeys(keys, math.inf), set(keys)
    for _ in range(most_rounds):
        tried = {g: at[g] + step[g] for g in open_}

        def of(x, y, g, tried=tried):
            if g not in tried:
                return np.zeros(2 + (width + 1) * (width + 2))
            z = np.column_stack([(x - mu[g]) / sd[g], np.ones(len(y))])
            logit = z @ tried[g]
            p = 1.0 / (1.0 + np.exp(-np.clip(logit, -700, 700)))
            return np.concatenate([[np.logaddexp(0.0, logit).sum() - logit[y > 0].sum(), len(y)], z.T @ (p - y), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

        found = grouped_sums(rows, of, 2 + (width + 1) * (width + 2))
        for g in sorted(open_):
            now = found[g][0] + 0.5 * (penalty * tried[g] ** 2).sum()
            if now > loss[g] + 1e-12 * abs(loss[g]):
                step[g] = step[g] / 2
            else:
                at[g], loss[g] = tried[g], now
                gradient = found[g][2 : width + 3] + penalty * at[g]
                gram = found[g][width + 3 :].reshape(width + 1, width + 1) + np.diag(penalty)
                step[g] = -np.linalg.lstsq(gram, gradient, rcond=None)[0]
            if np.abs(step[g]).max() <= tolerance * (1.0 + np.abs(at[g]).max()):
                open_.discard(g)
        if not open_:
            return {g: Head(tuple(at[g][:-1].tolist()), float(at[g][-1]), tuple(mu[g].tolist()), tuple(sd[g].tolist())) for g in keys}
    raise RuntimeError(f"{len(open_)} heads are not fitted after {most_rounds} rounds")
