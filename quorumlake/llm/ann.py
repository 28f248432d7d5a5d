"""Operator 6: approximate nearest neighbours over balanced posting lists."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import cut


def balanced_centroids(sample, leaf: int, rounds: int = 6):
    """Centroids of lists of at most `leaf` sample vectors: halved again and again along the line between two means."""
    import numpy as np

    todo, done = [np.arange(len(sample))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            done.append(sample[rows].mean(axis=0))
            continue
        own = sample[rows]
        a, b = own[0], own[np.argmax(((own - own[0]) ** 2).sum(axis=1))]
        for _ in range(rounds):
            side = own @ (b - a)
            half = np.argsort(side, kind="stable")
            a, b = own[half[: len(rows) // 2]].mean(axis=0), own[half[len(rows) // 2 :]].mean(axis=0)
        half = np.argsort(own @ (b - a), kind="stable")
        todo += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
    return np.array(done)


class CentroidGraph:
    """Centroids in memory, each linked to its nearest ones and to a few far ones; searched from a start by best first."""

    def __init__(self, centroids, links: int = 16, far: int = 4):
        import numpy as np

        self.points = np.asarray(centroids, float)
        n = len(self.points)
        squares = (self.points**2).sum(axis=1)
        near = []
        for at in range(0, n, 1024):
            d = squares[at : at + 1024, None] + squares - 2 * self.points[at : at + 1024] @ self.points.T
            near.append(np.argsort(d, axis=1, kind="stable")[:, 1 : links + 1])
        near = np.concatenate(near) if near else np.zeros((0, 0), int)
        jumps = (np.arange(n)[:, None] * 7919 + np.arange(1, far + 1) * (n // (far + 1) + 1)) % max(n, 1)
        self.links = [np.unique(np.concatenate([a, b])) for a, b in zip(near, jumps, strict=True)]
        back = [[] for _ in range(n)]
        for a, to in enumerate(near):
            for b in to:  # links go both ways, so every centroid can be reached
                back[b].append(a)
        self.links = [np.union1d(a, np.array(b, int)).astype(int) for a, b in zip(self.links, back, strict=True)]

    def search(self, vector, width: int):
        """(lists, distances) of up to `width` centroids found nearest, nearest first."""
        import heapq

        import numpy as np

        if len(self.points) <= width:
            d = np.sqrt(((self.points - vector) ** 2).sum(axis=1))
            order = np.argsort(d, kind="stable")
            return order, d[order]
        seen = np.zeros(len(self.points), bool)
        seen[0] = True
        first = float(((self.points[0] - vector) ** 2).sum())
        open_, best = [(first, 0)], [(-first, 0)]
        while open_:
            d, at = heapq.heappop(open_)
            if len(best) >= width and d > -best[0][0]:
                break
            new = self.links[at][~seen[self.links[at]]]
            seen[new] = True
            for x, i in zip(((self.points[new] - vector) ** 2).sum(axis=1).tolist(), new.tolist(), strict=True):
                if len(best) < width or x < -best[0][0]:
                    heapq.heappush(open_, (x, i))
                    heapq.heappush(best, (-x, i))
                    if len(best) > width:
                        heapq.heappop(best)
        found = sorted((-x, i) for x, i in best)
        return np.array([i for _, i in found]), np.sqrt([x for x, _ in found])


def vector_classes(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """(rep, v, ids): distinct valid vectors with their k + 1 smallest ids, all that k neighbours can be taken from.

    Valid: an id and as many components as most vectors have, none null, NaN or infinite, and not all zero. A vector
    that very many rows share is first reduced within parts of them.
    """
    good = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: x.cast("double")).alias("v"))
    good = good.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    common = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    good = good.where(F.size("v") == (common["n"] if common else 0)).withColumn("h", F.xxhash64("v"))
    some = good.withColumn("r", F.row_number().over(W.partitionBy("h", "v", F.expr("id & 255")).orderBy("id"))).where(F.col("r") <= k + 1)
    few = some.withColumn("r", F.row_number().over(W.partitionBy("h", "v").orderBy("id"))).where(F.col("r") <= k + 1)
    return few.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.get("ids", F.lit(0)).alias("rep"), "v", "ids")


def search(
    vectors: DataFrame, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, sample: int = 65_536, leaf: int = 16,
    replicas: int = 4, boundary: float = 0.1, probes: int = 384, ratio: float = 1.4, list_rows: int = 4096, seed: int = 5,
) -> DataFrame:
    """Operator 6. (query, rank, neighbour, score): each query's k nearest rows found among all vectors, itself left out.

    Nearness is the largest cosine. Centroids of balanced lists come from at most `sample` distinct vectors, those of
    smallest seeded hash; every vector is indexed: under its nearest centroid and, at a boundary, under up to `replicas`
    centroids at most (1 + boundary) times as far. A query searches the graph of centroids for `probes` lists and scans
    those at most `ratio` times as far as the nearest. Long lists are cut into parts of about list_rows rows, which are
    scanned by different tasks. Scores are cosines of the original vectors in double precision; ties go to the smaller
    id; fewer rows come back where there are fewer candidates. Equal vectors are searched once, each id its own row.

    queries: ids (column id_col). Rows that are not valid vectors take no part; repeated ids count once. Other columns
    are not read. At the defaults a sampled table has a list for each 16 vectors, of which a query probes 384 at most; up
    to leaf * probes vectors nothing is pruned but by the ratio.
    """
    spark = vectors.sparkSession
    classes = cut(vector_classes(vectors, id_col, vector_col, k))
    # bounded: `sample` vectors, and at most 2 * sample / leaf centroids
    picked = classes.select("v", F.xxhash64(F.lit(seed), "rep").alias("h"), "rep").orderBy("h", "rep").limit(sample).select("v").toArrow()
    import numpy as np

    unit = np.zeros((0, 1))
    if picked.num_rows:
        unit = picked.column("v").combine_chunks().flatten().to_numpy().reshape(picked.num_rows, -1)
        unit = unit / np.linalg.norm(unit, axis=1)[:, None]
    graph = spark.sparkContext.broadcast(CentroidGraph(balanced_centroids(unit, leaf) if len(unit) else np.zeros((0, 1))))

    def assign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        points = graph.value.points
        squares = (points**2).sum(axis=1)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = np.array(part.column(1).to_pylist(), float)
                x /= np.linalg.norm(x, axis=1)[:, None]
                d = np.sqrt(np.maximum(0, 1 + squares - 2 * x @ points.T))
                order = np.argsort(d, axis=1, kind="stable")[:, :replicas]
                near = np.take_along_axis(d, order, axis=1)
                who, which = np.nonzero(near <= (1 + boundary) * near[:, :1])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(who)), part.column(1).take(pa.array(who)), pa.array(order[who, which].astype("int32"))], names=["rep", "v", "list"])

    def select(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            reps, rows, lists = batch.column(0).to_pylist(), [], []
            for i, v in enumerate(batch.column(1).to_pylist()):
                v = np.array(v, float)
                found, far = graph.value.search(v / np.linalg.norm(v), probes)
                found = found[far <= ratio * far[0]]
                rows += [i] * len(found)
                lists += found.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([reps[i] for i in rows], pa.int64()), batch.column(1).take(pa.array(rows, pa.int32())), pa.array(lists, pa.int32())], names=["rep", "v", "list"])

    form = "rep long, v array<double>, list int"
    postings = cut(classes.select("rep", "v").mapInArrow(assign, form))
    parts = postings.groupBy("list").agg(F.ceil(F.count("*") / list_rows).cast("int").alias("parts"))
    asked = queries.select(F.col(id_col).cast("long").alias("query")).distinct()
    # ids beyond a class's smallest k + 1 are found by their vector
    owners = vectors.where(F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("query"), F.transform(vector_col, lambda x: x.cast("double")).alias("v")).join(asked, "query").dropDuplicates(["query"])
    owners = cut(owners.join(classes.select("rep", "v"), "v").select("query", "rep"))
    wanted = classes.join(owners.select("rep").distinct(), "rep", "left_semi").select("rep", "v")
    # parts has a row for each centroid at most
    probing = wanted.repartition("rep").mapInArrow(select, form).join(F.broadcast(parts), "list")
    probing = probing.select("rep", "v", "list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    sizes = parts.select(F.col("list").alias("long_list"), F.col("parts").alias("cuts"))
    held = postings.join(F.broadcast(sizes), F.col("list") == F.col("long_list"))
    held = held.select(F.col("rep").alias("near"), F.col("v").alias("x"), "list", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int").alias("part"))

    def scan(rows, asking):
        import pandas as pd

        out = [(np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0))]
        if len(rows) and len(asking):
            x = np.array(rows["x"].tolist(), float)
            norms, ids = np.sqrt((x * x).sum(axis=1)), rows["near"].to_numpy()
            for at in range(0, len(asking), 256):
                some = asking.iloc[at : at + 256]
                q = np.array(some["v"].tolist(), float)
                rough = q @ x.T / norms
                top = min(k + 1, len(rows))
                for i, query in enumerate(some["rep"].to_numpy()):
                    edge = np.partition(rough[i], len(rows) - top)[len(rows) - top]
                    best = np.flatnonzero(rough[i] >= edge - 1e-9 * abs(edge) - 1e-12)
                    exact = (x[best] * q[i]).sum(axis=1) / (norms[best] * np.sqrt((q[i] * q[i]).sum()))
                    first = np.lexsort((ids[best], -exact))[: k + 1]
                    out.append((np.full(len(first), query), ids[best][first], exact[first]))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
        return pd.DataFrame({"rep": a, "near": b, "score": c})

    hits = held.groupBy("list", "part").cogroup(probing.groupBy("list", "part")).applyInPandas(scan, T.StructType.fromDDL("rep long, near long, score double"))
    best = W.partitionBy("rep").orderBy(F.desc("score"), "near")
    hits = hits.dropDuplicates(["rep", "near"]).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)
    members = hits.join(classes.select(F.col("rep").alias("near"), "ids"), "near").select("rep", "score", F.explode("ids").alias("neighbour"))
    members = cut(members.withColumn("r", F.row_number().over(W.partitionBy("rep").orderBy(F.desc("score"), "neighbour"))).where(F.col("r") <= k + 1).drop("r"))
    # at most k + 1 rows for each query
    out = owners.join(members, "rep").where("query <> neighbour")
    out = out.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "neighbour")).cast("int")).where(F.col("rank") <= k)
    return out.select("query", "rank", "neighbour", "score")
