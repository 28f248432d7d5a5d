"""Splits by site, and what is learnt on the training part alone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quorumlake import constants as C
from quorumlake.functions.identifiers import collision_form
from quorumlake.sources.staging import cut

from .resampling import seeded
from .shift import permutation, permutations


def site_ranks(sites: DataFrame, *stream: int | str, label: str = "site_label") -> DataFrame:
    """(label, rank): distinct sites in a seeded order; a site's rank depends on the byte-ordered list of sites and the stream."""
    names = [r[0] for r in sites.select(label).distinct().orderBy(label).collect()]  # a row for each site
    ranks = permutation(len(names), *stream)
    return sites.sparkSession.createDataFrame(list(zip(names, ranks, strict=True)), f"{label} {sites.schema[label].dataType.simpleString()}, rank int")


def step_ranks(sites: DataFrame, streams: list[tuple[float, int, str]], *, by: list[str] = (), label: str = "site_label", steps: int = len(C.TAU_GRID)) -> DataFrame:
    """(by..., alpha, mode_idx, stream, step, label, rank): for each tested step of a walk an order of a group's sites of its own.

    streams: (alpha, mode_idx, stream). A stream gives one permutation after another, the k-th for the k-th threshold that
    is tested; it depends on nothing but its name and the number of sites. Sites are numbered in the order of their labels.
    """
    kind = sites.schema[label].dataType.simpleString()

    @F.pandas_udf("array<array<int>>")
    def orders(n: pd.Series, alpha: pd.Series, mode_idx: pd.Series, stream: pd.Series) -> pd.Series:
        return pd.Series([permutations(steps, size, C.ALPHA_LADDER.index(a), m, s) for size, a, m, s in zip(n, alpha, mode_idx, stream, strict=True)])

    names = F.array_sort(F.collect_set(label))  # a label for each site
    named = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.lit(m).alias("mode_idx"), F.lit(s).alias("stream")) for a, m, s in streams])
    groups = sites.groupBy(*by).agg(names.alias("names")).withColumn("of", F.explode(named)).select(*by, "names", "of.*")
    found = groups.withColumn("orders", orders(F.size("names"), "alpha", "mode_idx", "stream"))
    stepped = found.select(*by, "alpha", "mode_idx", "stream", "names", F.posexplode("orders").alias("step", "order"))
    pairs = F.arrays_zip(F.col("names").cast(f"array<{kind}>").alias("name"), F.col("order").alias("rank"))
    return stepped.select(*by, "alpha", "mode_idx", "stream", (F.col("step") + 1).alias("step"), F.explode(pairs).alias("p")).select(*by, "alpha", "mode_idx", "stream", "step", F.col("p.name").alias(label), F.col("p.rank").alias("rank"))


def split_sites(sites: DataFrame, *stream: int | str, label: str = "site_label", fractions: tuple[float, float, float] = C.SPLIT_FRACTIONS) -> DataFrame:
    """(label, split): whole sites to train, aux and cal; the last takes what rounding leaves."""
    ranks = site_ranks(sites, *stream, label=label)
    n = ranks.count()
    train, aux = round(fractions[0] * n), round(fractions[1] * n)
    return ranks.select(label, F.when(F.col("rank") < train, "train").when(F.col("rank") < train + aux, "aux").otherwise("cal").alias("split"))


def hold_out_sites(sites: DataFrame, replicate: int, *, label: str = "site_label", n_target: int = C.N_TARGET_SITES, least: int = C.MIN_TOTAL_SITES) -> DataFrame:
    """(label, split): target sites held out first, the rest 40/20/40 with truncation. Raises on too few sites."""
    ranks = site_ranks(sites, C.SPLIT_NAMESPACE, replicate, label=label)
    n = ranks.count()
    if n < least:
        raise ValueError(f"{n} sites, {least} are needed (reason=too-few-sites)")
    rest = n - n_target
    train, aux = int(C.SPLIT_FRACTIONS[0] * rest), int(C.SPLIT_FRACTIONS[1] * rest)
    if rest - train - aux < C.MIN_CAL_CLUSTERS:
        raise ValueError(f"{rest - train - aux} calibration sites (reason=too-few-cal-clusters)")
    r = F.col("rank")
    return ranks.select(label, F.when(r < n_target, "target").when(r < n_target + train, "train").when(r < n_target + train + aux, "aux").otherwise("cal").alias("split"))


def replicate_splits(sites: DataFrame, replicates: int, *, label: str = "site_id", n_target: int = C.N_TARGET_SITES, least: int = C.MIN_TOTAL_SITES, seed: int = C.SEED) -> DataFrame:
    """(replicate, label, split): hold_out_sites for many replicates, as one relation: each orders the sites by seeded numbers of its own."""
    n = sites.select(label).distinct().count()
    rest = n - n_target
    train, aux = int(C.SPLIT_FRACTIONS[0] * rest), int(C.SPLIT_FRACTIONS[1] * rest)
    if n < least:
        raise ValueError(f"{n} sites, {least} are needed (reason=too-few-sites)")
    if rest - train - aux < C.MIN_CAL_CLUSTERS:
        raise ValueError(f"{rest - train - aux} calibration sites (reason=too-few-cal-clusters)")
    every = sites.select(label).distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    order = W.partitionBy("replicate").orderBy(seeded(seed, "split", F.col("replicate"), F.col(label)), label)
    r = F.row_number().over(order) - 1
    split = F.when(r < n_target, "target").when(r < n_target + train, "train").when(r < n_target + train + aux, "aux").otherwise("cal")
    return cut(every.select("replicate", label, split.alias("split")))  # read in many places, each of which would scan the records again


def with_split(records: DataFrame, split: DataFrame, label: str = "site_label") -> DataFrame:
    return records.join(split, label)


def assert_disjoint(records: DataFrame, label: str = "site_label", split: str = "split") -> None:
    """Raises ValueError if a site, by its coarser form, is in more than one split."""
    sites = records.select(label, split).distinct()
    both = sites.groupBy(collision_form(F.col(label)).alias("form")).agg(F.count_distinct(split).alias("n"), F.min(label).alias("label")).where("n > 1").orderBy("label").limit(4).collect()
    if both:
        raise ValueError(f"sites in more than one split: {[r['label'] for r in both]} (reason=site-overlap)")


def assert_covering(records: DataFrame, split: DataFrame, label: str = "site_label") -> None:
    """Raises ValueError unless the splits together hold every site of the records and no other."""
    own, dealt = records.select(label).distinct(), split.select(label).distinct()
    left = own.join(dealt, label, "left_anti").orderBy(label).limit(4).collect()
    extra = dealt.join(own, label, "left_anti").orderBy(label).limit(4).collect()
    if left or extra:
        raise ValueError(f"sites without a split: {[r[0] for r in left]}, splits of other sites: {[r[0] for r in extra]} (reason=split-coverage)")


def train_means(records: DataFrame, columns: list[str], split: str = "split", fallback: float = C.IMPUTE_FALLBACK) -> dict[str, float]:
    """The mean of each column over training records; the fallback where none has a value."""
    row = records.where(F.col(split) == "train").agg(F.count("*").alias("_n"), *[F.avg(c).alias(c) for c in columns]).first()
    if row["_n"] == 0:
        raise ValueError("no training records (reason=impute-fit-empty)")
    return {c: fallback if row[c] is None else row[c] for c in columns}


def impute(records: DataFrame, columns: list[str], split: str = "split") -> tuple[DataFrame, dict[str, float]]:
    """records with missing cells filled by training means, and the means."""
    means = train_means(records, columns, split)
    return records.na.fill(means), means
