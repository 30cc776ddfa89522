"""Exact vector search on native arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def similarity(d2: Column) -> Column:
    return 1 / (1 + d2)


def normalized(v: Column) -> Column:
    """The vector at length one; a null vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 if lengths differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def present(table: DataFrame, embedding: str = "embedding") -> DataFrame:
    return table.where(F.col(embedding).isNotNull() & (F.size(embedding) > 0))


def knn(table: DataFrame, query: list[float], k: int, id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k rows nearest to one query vector, by squared distance, then id; all rows if there are fewer."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return present(table, embedding).withColumn("d2", squared_l2(F.col(embedding), q)).orderBy("d2", id).limit(k)


#: Bytes of queries that are broadcast at once.
QUERY_BYTES = 64 << 20


def knn_batch(table: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", embedding: str = "embedding", most_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k nearest rows for each of the queries (query_id, query): (query_id, rank, id, d2).

    Every query needs every row. Queries are cut by their id's hash into parts
    whose measured size is under ``most_bytes``, and a part at a time is met with
    the table; tasks keep the k best of each query before anything is shuffled.
    """
    size = queries.agg(F.sum(F.size("query") * 8 + 64)).first()[0] or 0
    parts = max(1, -(-2 * size // most_bytes))
    order, out = Window.partitionBy("query_id").orderBy("d2", id), None
    rows = present(table, embedding)
    for part in range(parts):
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        met = rows.join(F.broadcast(own), how="cross").select("query_id", id, squared_l2(F.col(embedding), F.col("query")).alias("d2"))
        best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        out = best if out is None else out.unionByName(best)
    return out.select("query_id", "rank", id, "d2")


def mean_pool(pieces: DataFrame, keys: list[str], embedding: str = "embedding") -> DataFrame:
    """The unweighted mean vector of each group, of vectors of one length. Sums are made in each task, so that a row per group and task is shuffled."""
    given = pieces.select(*keys, doubles(F.col(embedding)).alias("_v")).where("_v is not null")
    schema = given.withColumn("_n", F.lit(0).cast("long")).schema
    arrow = to_arrow_schema(schema)

    def run(batches):
        sums: dict[tuple, list] = {}
        for batch in batches:
            *names, vectors = batch.columns
            own = zip(*[c.to_pylist() for c in names]) if names else [()] * batch.num_rows
            for key, v in zip(own, vectors.to_pylist()):
                held = sums.get(key)
                if held is None:
                    sums[key] = [np.array(v, np.float64), 1]
                else:
                    held[0] += v
                    held[1] += 1
            if len(sums) > 100_000:
                yield rows(sums)
                sums = {}
        yield rows(sums)

    def rows(sums):
        columns = [[key[i] for key in sums] for i in range(len(keys))] + [[s[0].tolist() for s in sums.values()], [s[1] for s in sums.values()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    sums = given.mapInArrow(run, schema)
    none = F.array().cast("array<double>")
    place = lambda a, v: F.when(F.size(a) == 0, v).otherwise(F.zip_with(a, v, lambda x, y: x + y))
    held = sums.groupBy(*keys).agg(F.collect_list("_v").alias("_l"), F.sum("_n").alias("_n"))
    return held.select(*keys, F.transform(F.aggregate("_l", none, place), lambda x: x / F.col("_n")).alias(embedding))


def lookup(table: DataFrame, ids: list, id: str = "vec_id") -> DataFrame:
    return table.where(F.col(id).isin(ids))
