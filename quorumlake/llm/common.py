"""What several corpus operators share: cutting lineage, words, hot-key-safe components, order statistics."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Hashable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_held: dict = {}


def let_go() -> None:
    """Frees what tasks before left in this Python worker; for tasks that hold nothing themselves."""
    _held.clear()


def held(key: Hashable, make: Callable[[], object]):
    """What `make` gives, held in this Python worker from task to task until one asks for another key or lets go.

    Workers outlive tasks and stages, so what one operator has cached would come on top of what the next one needs.
    """
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one of our own only where the setting is absent."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quorumlake.own.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="quorumlake-")
        spark.conf.set("quorumlake.own.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a narrow table with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage of a table by writing it as Parquet in the shared folder and reading it again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_fields(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of df with further fields behind."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column) -> Column:
    """The words of a text, in order; none for a null or blank text."""
    return F.coalesce(F.array_remove(F.split(text, BLANK), ""), F.array().cast("array<string>"))


def runs(tokens: Column, width: int) -> Column:
    """Structs (t0, t1, ...) of `width` successive tokens, one for each place, repeats included.

    Where there are fewer tokens, the whole sequence with nulls after it; nothing for no tokens.
    """
    zipped = F.arrays_zip(*[(tokens if j == 0 else F.slice(tokens, j + 1, F.greatest(F.size(tokens), F.lit(1)))).alias(f"t{j}") for j in range(width)])
    return F.slice(zipped, F.lit(1), F.greatest(F.size(tokens) - width + 1, F.lit(1)))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component being the smallest node reachable.

    Alternates large-star and small-star steps. Minima are pre-aggregated and joined back, so a node with very many
    neighbours is never gathered in one place. Every round is checkpointed; rounds grow with the logarithm of the
    longest chain. Nodes without edges are absent.
    """

    def star(pairs: DataFrame) -> DataFrame:
        """Links each neighbour and its node u to the smallest of them; pairs: (u, v)."""
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return pairs.join(least.hint("merge"), "u")  # a broadcast would pass the driver, several times a round

    def tidy(df: DataFrame) -> DataFrame:
        return cut(df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    now = tidy(edges.select("a", "b"))
    seen = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b"), F.col("a")))
        large = star(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = star(large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
        small = down.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(down.select(F.col("u"), F.col("m")))
        now = tidy(small)
        mark = tuple(now.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
        now.select(F.col("b"), F.col("b")).distinct()
    )


def kth_largest(df: DataFrame, key: str, k: int, bins: int = 1024) -> float | None:
    """The k-th largest value of a double column, by histograms of at most `bins` rows that narrow in on it.

    None where the table has fewer than k rows that are not null; k counts from 1.
    """
    rows = df.where(F.col(key).isNotNull()).select(key)
    low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
    if n < k or k < 1:
        return None
    above = 0
    while low < high:
        width = (high - low) / bins
        if width <= 0 or low + width == low:
            break
        slot = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)).cast("int"), F.lit(bins - 1))
        counts = rows.where(F.col(key).between(low, high)).groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        for r in counts.orderBy(F.desc("slot")).limit(bins).collect():
            if above + r["n"] >= k:
                low, high = r["lo"], r["hi"]
                break
            above += r["n"]
    return high
