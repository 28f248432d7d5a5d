"""Site identifiers: canonical forms, forms for finding collisions, dense numbers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


@F.pandas_udf(T.StringType())
def _compose(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def canonical_site(raw: Column) -> Column:
    """Compatibility-composed text without format characters and white space around it; NULL stays NULL."""
    visible = F.regexp_replace(_compose(raw.cast("string")), r"\p{Cf}", "")
    return F.regexp_replace(visible, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def canonical_number_site(raw: Column) -> Column:
    """The canonical form of a double: whole numbers below 2**53 without a decimal point; NULL for all else."""
    whole = (raw == F.floor(raw)) & (F.abs(raw) < float(1 << 53))
    return F.when(whole, raw.cast("bigint").cast("string"))


def collision_form(canonical: Column) -> Column:
    """A coarser form: case-folded, whole numbers without sign plus, leading zeros and a zero fraction."""
    folded = _fold(canonical)
    digits = F.regexp_replace(folded, r"^\+", "")
    number = F.regexp_replace(F.regexp_replace(digits, r"^(-?)0+(?=[0-9])", "$1"), r"\.0*$", "")
    return F.when(digits.rlike(r"^-?[0-9]+(\.0*)?$"), F.when(number == "-0", "0").otherwise(number)).otherwise(folded)


class SiteCollision(ValueError):
    """Different site identifiers that mean the same."""


def dense_sites(records: DataFrame, raw_col: str) -> DataFrame:
    """records with site_label and site_id, dense from 0 in the byte order of labels.

    Raises SiteCollision where two labels share their collision form, or a label is missing. Only the distinct raw values,
    few for each site, are brought to their canonical form, compared and ranked.
    """
    raw = records.select(F.col(raw_col).alias("_raw")).distinct().withColumn("site_label", canonical_site(F.col("_raw")))
    labels = raw.select("site_label").distinct()
    if not labels.where("site_label is null or site_label = ''").isEmpty():
        raise SiteCollision("a site identifier is missing (reason=missing-site)")
    twice = labels.groupBy(collision_form(F.col("site_label")).alias("form")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("site_label")).alias("labels")).where("n > 1").orderBy("form").limit(4).collect()
    if twice:
        raise SiteCollision(f"site identifiers mean the same: {[r['labels'] for r in twice]} (reason=site-collision)")
    ids = labels.withColumn("site_id", (F.row_number().over(W.orderBy("site_label")) - 1).cast("int"))
    own = records.withColumn("_own", F.col(raw_col)).drop("site_label")
    named = raw.join(ids, "site_label")
    return own.join(named, F.col("_own").eqNullSafe(F.col("_raw"))).drop("_own", "_raw")


class LabelError(ValueError):
    """Labels that are not two-valued."""


def binary_label(records: DataFrame, raw_col: str, positive: str, *, allow_absent_positive: bool = False) -> DataFrame:
    """records with the boolean y: whether the raw label is the positive one of exactly two values."""
    if not records.where(F.col(raw_col).isNull()).isEmpty():
        raise LabelError("a label is missing (reason=missing-label)")
    seen = [r[0] for r in records.groupBy(F.col(raw_col).cast("string")).count().limit(3).collect()]
    if len(seen) > 2:
        raise LabelError("labels have more than two values (reason=not-binary)")
    if positive not in seen and not (allow_absent_positive and len(seen) < 2):
        raise LabelError(f"no label is {positive!r} (reason=absent-positive)")
    return records.withColumn("y", F.col(raw_col).cast("string") == positive)
