"""Operator 12: whitening of embeddings along principal directions found by LOBPCG."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept

#: Rows of a batch that become one matrix.
ROWS = 4096
LONGEST = (1 << 63) - 1
#: Scaled entries farther from zero count as this.
FARTHEST = 9e18


def finite_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows whose vector is there, not empty, and holds neither null nor NaN nor an infinity."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    good = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0))
    return good.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def commonest_length(vectors: DataFrame, vector_col: str = "v") -> int:
    """The length that most vectors have, of tied ones the smallest; 0 for an empty table."""
    found = vectors.groupBy(F.size(vector_col).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return found["n"] if found else 0


def matrix(column):
    """An Arrow column of lists of one length as a matrix of doubles or longs."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class CentredRows:
    """Rows of whole numbers (id, x), their count and their exact sums; what is asked of them about their mean is summed task by task."""

    def __init__(self, rows: DataFrame, width: int):
        self.rows, self.width = rows, width
        # width numbers, whatever the rows
        place = rows.select(F.posexplode("x").alias("place", "c")).groupBy("place").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("place").collect()
        self.n, self.sums = (place[0]["n"] if place else 0), [int(r["s"]) for r in place]

    def mean(self):
        import numpy as np

        return np.array([s / self.n for s in self.sums])

    def summed(self, of, size: int):
        """The sum over tasks of of(centred rows), an array of `size` numbers; centring comes first."""
        import numpy as np

        mean = self.mean()

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            total = np.zeros(size)
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    total += np.asarray(of(matrix(batch.column(0).slice(at, ROWS)) - mean)).ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["place", "part"])

        # `size` rows a task, summed by place
        parts = self.rows.select("x").mapInArrow(run, "place int, part double").groupBy("place").agg(F.sum("part").alias("part")).collect()
        out = np.zeros(size)
        for r in parts:
            out[r["place"]] = r["part"]
        return out

    def times(self, block):
        """The covariance (divisor n) times a block of columns: a product over centred rows."""
        return self.summed(lambda d: d.T @ (d @ block), block.size).reshape(block.shape) / self.n

    def trace(self) -> float:
        return float(self.summed(lambda d: (d * d).sum(), 1)[0]) / self.n


def orthonormal(block, against=None, least: float = 1e-10):
    """An orthonormal basis of a block's columns off those of `against`; directions that nearly vanish are left out."""
    import numpy as np

    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(2):  # twice, as what is left may be small
        if against is not None and block.size:
            block = block - against @ (against.T @ block)
        if block.size:
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            block = u[:, s > least]
    return block


def leading_directions(rows: CentredRows, k: int, *, guard: int = 16, tolerance: float = 1e-12, most_rounds: int = 500, seed: int = 3):
    """(values, directions, residual): the k leading eigenpairs of the rows' covariance, largest value first, by LOBPCG.

    Each round multiplies the covariance with the blocks of residuals and previous directions, one job over the rows, and
    takes the Ritz vectors of the span of iterate, residuals and previous directions, on an orthonormal basis. The block
    has `guard` columns more than asked for, which speeds up close values; a width of at most three blocks is spanned
    whole after a few rounds. It ends when no residual of the k pairs, measured by a product of their own, is over
    tolerance times the largest value; RuntimeError if that takes more than most_rounds rounds.
    """
    import numpy as np

    width = rows.width
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, min(width, k + guard))))[0]
    size, ax, p, residual = x.shape[1], rows.times(x), np.zeros((width, 0)), float("inf")
    k = min(k, size)
    for _ in range(most_rounds):
        small, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        x, ax, values = x @ turn[:, ::-1], ax @ turn[:, ::-1], small[::-1]
        scale = max(abs(values[0]), np.finfo(float).tiny)
        rest = ax - x * values
        if np.linalg.norm(rest[:, :k], axis=0).max() <= tolerance * scale:
            own = rows.times(x)  # certified by a product of their own
            values = np.einsum("ij,ij->j", x, own)
            rest = own - x * values
            residual = float(np.linalg.norm(rest[:, :k], axis=0).max())
            if residual <= tolerance * scale:
                order = np.argsort(-values[:k], kind="stable")
                return values[order], x[:, order], residual / scale
            ax = own
        more = orthonormal(rest, x)
        more = np.concatenate([more, orthonormal(p, np.concatenate([x, more], axis=1))], axis=1)
        if not more.size:
            x = orthonormal(x)
            ax, p = rows.times(x), p[:, :0]
            continue
        basis, product = np.concatenate([x, more], axis=1), np.concatenate([ax, rows.times(more)], axis=1)
        g = basis.T @ product
        _, turn = np.linalg.eigh((g + g.T) / 2)
        turn = turn[:, ::-1][:, :size]
        p = basis[:, x.shape[1] :] @ turn[x.shape[1] :]
        x, ax = basis @ turn, product @ turn
    raise RuntimeError(f"residuals are not certified after {most_rounds} rounds")


def whiten(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, scale: int = 1024, offset: int = 100_000, tolerance: float = 1e-12,
) -> DataFrame:
    """Operator 12. (id, component, n, deviation, whitened, explained, identity_error, residual, deviation_exact).

    Each entry c becomes the whole number floor(scale * c) + offset. A row for each fitted vector and component:
    the centred vector's coordinate along the component's unit eigenvector over the square root of its eigenvalue;
    deviation, the exact sum over entries of (n * x - sum)^2 (null beyond a long; deviation_exact has it as a decimal);
    the eigenvalue's share of the trace; how far the covariance of all whitened rows is from the identity; and the
    certified residual in parts of the largest eigenvalue.

    Fitted are all rows whose vector holds no null, NaN or infinity, is not empty and has the length that most have (of
    tied lengths the smallest); repeated rows and null ids are rows like others. Scaled entries
    beyond 9e18 count as that. Components whose eigenvalue is at most 1e-11 of the largest, or zero, have no whitened coordinates and are
    left out, so equal vectors, a single one or an empty table give no rows. Other columns are not read.

    The driver holds blocks of width times (components + 16) numbers, whatever the number of rows.
    """
    import numpy as np

    good = finite_vectors(vectors, id_col, vector_col)
    whole = F.transform("v", lambda c: F.floor(F.least(F.greatest(c * scale, F.lit(-FARTHEST)), F.lit(FARTHEST))) + F.lit(offset).cast("long"))
    every = kept(good.select("id", whole.alias("x")), "whole")
    width = commonest_length(every, "x")
    rows = CentredRows(every.where(F.size("x") == width), width)
    schema = T.StructType([T.StructField("id", good.schema["id"].dataType), *T.StructType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double, identity_error double, residual double, deviation_exact decimal(38,0)").fields])
    nothing = vectors.sparkSession.createDataFrame([], schema)
    if not rows.n:
        return nothing
    trace = rows.trace()
    if trace <= 0:
        return nothing
    values, directions, residual = leading_directions(rows, components, tolerance=tolerance)
    there = values > 1e-11 * values[0]
    values, directions = values[there], directions[:, there]
    mean, n, sums, m = rows.mean(), rows.n, rows.sums, int(there.sum())
    to = directions / np.sqrt(values)
    middle = rows.summed(lambda d: (d @ to).sum(axis=0), m) / n
    second = rows.summed(lambda d: (w := d @ to - middle).T @ w, m * m).reshape(m, m) / n
    error, explained = float(np.abs(second - np.eye(m)).max()), values / trace

    def run(batches: Iterator) -> Iterator:
        import decimal

        import pyarrow as pa

        exact = decimal.Context(prec=60)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = matrix(part.column(1))
                white = (x - mean) @ to
                largest = max(abs(n * int(f(x[:, j])) - sums[j]) for j in range(width) for f in (np.min, np.max))
                if largest**2 * width <= LONGEST:
                    off = x * n - np.array(sums)
                    square = [int(s) for s in (off * off).sum(axis=1)]
                else:  # whole numbers of any size
                    square = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
                count = len(square)
                deviation = pa.array([s if s <= LONGEST else None for s in square], pa.int64())
                long = pa.array([exact.create_decimal(s) if s < 10**38 else None for s in square], pa.decimal128(38, 0))
                who = pa.array(np.repeat(np.arange(count), m))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(who), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), count)), pa.array(np.full(count * m, n)), deviation.take(who), pa.array(white.ravel()),
                     pa.array(np.tile(explained, count)), pa.array(np.full(count * m, error)), pa.array(np.full(count * m, residual)), long.take(who)], names=schema.names)

    return rows.rows.select("id", "x").mapInArrow(run, schema)
