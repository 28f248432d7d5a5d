"""Cohorts for tests: sites of Gaussian features, each site drawn from a stream of its own."""

from __future__ import annotations

from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Population:
    """A population of sites whose records have Gaussian features with class-conditional means."""

    mean_log_size: float = 6.0
    sd_log_size: float = 1.1
    least: int = 20
    most: int = 5000
    site_sd: float = 0.5
    base_rate: float = 0.095
    separation: float = 1.1
    n_features: int = 8
    n_signal: int = 4


def draw_cohort(spark: SparkSession, n_sites: int, seed: int, population: Population = Population(), *, label_base_rate: float | None = None, concept_intercept: float = 0.0, prefix: str = "s-") -> DataFrame:
    """(site_label, y, x): generated site by site, each site by its own stream, so a draw does not depend on partitions.

    label_base_rate shifts the share of positives, concept_intercept the label given the features; not both.
    """
    if label_base_rate is not None and concept_intercept:
        raise ValueError("label shift and concept shift exclude each other (reason=two-shifts)")
    p, rate = SimpleNamespace(**vars(population)), label_base_rate  # workers do not know this module

    def one_site(batches):
        import numpy as np
        import pandas as pd

        for frame in batches:
            for site in frame["id"]:
                rng = np.random.default_rng(np.random.SeedSequence([seed, int(site)]))
                n = int(np.clip(np.exp(rng.normal(p.mean_log_size, p.sd_log_size)), p.least, p.most))
                base = p.base_rate if rate is None else rate
                share = 1.0 / (1.0 + np.exp(-(np.log(base / (1 - base)) + rng.normal(0.0, p.site_sd))))
                y = rng.random(n) < share
                direction = np.zeros(p.n_features)
                direction[: p.n_signal] = 1.0 / np.sqrt(p.n_signal)
                x = rng.normal(size=(n, p.n_features)) + np.where(y, p.separation, -p.separation)[:, None] * direction
                if concept_intercept:
                    logit = np.log(share / (1 - share)) + 2 * p.separation * (x @ direction) + concept_intercept
                    y = rng.random(n) < 1.0 / (1.0 + np.exp(-logit))
                yield pd.DataFrame({"site_label": f"{prefix}{site:04d}", "y": y, "x": list(x)})

    return spark.range(0, n_sites, 1, min(n_sites, spark.sparkContext.defaultParallelism)).mapInPandas(one_site, "site_label string, y boolean, x array<double>")
