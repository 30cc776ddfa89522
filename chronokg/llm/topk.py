"""Exact top-k by inner product over multi-resolution segment statistics.

A vector is cut into segments; with a segment's mean m and deviation s over L
places, the inner product of two segments is at most L (m m' + s s'), which says
the same as the lower bound L ((m - m')² + (s - s')²) of their squared distance.
Few long segments are tried first, then more, at last segments of two places,
and exact integer products are taken of the pairs that could still reach a
query's k-th score so far.

Queries and candidates are packed into blocks of bounded size, and blocks, not
rows, are met with blocks: a task reads its candidates' blocks against each
block of queries, keeps every query's k best and its k-th score, which rises
from block to block, and returns k rows for each query. Nothing but counts
reaches the driver, and nothing is broadcast by hand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronokg.llm.common import arrow_batches, materialize

#: Bytes and rows of a block at most; blocks of queries that a task meets its candidates with.
SCALE, BLOCK_BYTES, BLOCK_ROWS, GROUP = 256.0, 1 << 20, 1_024, 64
#: Below this share of pairs, a step looks at pairs one by one; above it a product of whole blocks is cheaper.
SPARSE = 0.1


def usable(vectors: DataFrame, vec_id: str, embedding: str, scale: float) -> DataFrame:
    """(vec_id, v): scaled components as doubles, of vectors without null or non-finite ones and with an id."""
    e = f"`{embedding}`"
    good = f"{e} is not null and size({e}) > 0 and forall({e}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
    return vectors.where(F.col(f"`{vec_id}`").isNotNull()).where(good).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.expr(f"transform({e}, x -> cast(x as double) * {scale}D)").alias("v")
    )


def packed(rows: DataFrame, block: str, most: int = BLOCK_ROWS) -> DataFrame:
    """Blocks (``block``, n, ids, x) of vectors of n components, rounded down; a vector too large for a double is an error that names it."""

    def out(n: int, ids: list, vectors: list):
        return {"n": n, "ids": np.array(ids, "<i8").tobytes(), "x": np.array(vectors, "<f8").tobytes()}

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            done = []
            values = batch.column(1)
            flat, ends = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
            for i, a, b in zip(batch.column(0).to_pylist(), ends.tolist(), ends[1:].tolist()):
                v = np.floor(flat[a:b])
                if not np.isfinite(v).all():
                    raise ValueError(f"a component of vector {i} is beyond double precision when scaled")
                ids, vectors = held.setdefault(b - a, ([], []))
                ids.append(i)
                vectors.append(v)
                if len(ids) >= most or len(ids) * (b - a) * 8 >= BLOCK_BYTES:
                    done.append(out(b - a, *held.pop(b - a)))
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if held:
            yield pa.RecordBatch.from_pylist([out(n, *h) for n, h in held.items()], schema)

    schema = pa.schema([("n", pa.int32()), ("ids", pa.binary()), ("x", pa.binary())])
    return rows.mapInArrow(run, "n int, ids binary, x binary").withColumn(block, F.monotonically_increasing_id())


class Block:
    """Vectors of one length and their statistics, coarse to fine: √L·mean and √L·deviation of each segment, so that a product of rows bounds the inner product."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x, self.n = ids, x, x.shape[1]
        self.top = float(np.abs(x).max()) if x.size else 0.0
        self.norm = float(np.sqrt(self.n)) * self.top

    @property
    def levels(self):
        if not hasattr(self, "_levels"):
            self._levels = [self._statistics(parts) for parts in sorted({min(p, self.n) for p in (4, 16, max(1, self.n // 2))})]
        return self._levels

    def _statistics(self, parts: int) -> np.ndarray:
        out = []
        for segment in np.array_split(self.x, parts, axis=1):
            root = np.sqrt(segment.shape[1])
            out += [segment.mean(axis=1) * root, segment.std(axis=1) * root]
        return np.stack(out, axis=1)


def products(queries: Block, candidates: Block, q: np.ndarray, c: np.ndarray, whole: bool) -> np.ndarray:
    """Exact inner products of the pairs, as 64-bit integers; one that doesn't fit is an error that names its vectors."""
    most = queries.n * queries.top * candidates.top
    if most < 2**53:  # every partial sum is a whole number that a double holds
        if whole:
            return (queries.x @ candidates.x.T)[q, c].astype(np.int64)
        return np.concatenate([np.einsum("ij,ij->i", queries.x[q[p : p + 65_536]], candidates.x[c[p : p + 65_536]]) for p in range(0, len(q), 65_536)] or [np.empty(0)]).astype(np.int64)
    if most < 2**62:
        x, y = queries.x.astype(np.int64), candidates.x.astype(np.int64)
        return np.concatenate([np.einsum("ij,ij->i", x[q[p : p + 65_536]], y[c[p : p + 65_536]]) for p in range(0, len(q), 65_536)] or [np.empty(0, np.int64)])
    x, y = ([[int(v) for v in row] for row in b.x.tolist()] for b in (queries, candidates))
    out = np.empty(len(q), np.int64)
    for k, (i, j) in enumerate(zip(q.tolist(), c.tolist())):
        score = sum(a * b for a, b in zip(x[i], y[j]))
        if not -(2**63) <= score < 2**63:
            raise ValueError(f"the product of vectors {queries.ids[i]} and {candidates.ids[j]} is beyond 64 bits")
        out[k] = score
    return out


class Best:
    """The k best candidates so far of each query of a block, and how many pairs each step left."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k, self.seen = queries, k, []
        self.q, self.c, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.least = np.full(len(queries.ids), -np.inf)

    def add(self, candidates: Block) -> None:
        queries = self.queries
        other = queries.ids[:, None] != candidates.ids[None, :]
        pairs, left = other.size, [int(other.sum())]
        slack = 1e-9 * queries.norm * candidates.norm + 1
        if np.isfinite(self.least).any():
            floor = self.least - slack
            q, c = None, None
            for own, theirs in zip(queries.levels, candidates.levels):
                if q is None:
                    other &= own @ theirs.T >= floor[:, None]
                    left.append(int(other.sum()))
                    if left[-1] < SPARSE * pairs:
                        q, c = np.nonzero(other)
                else:
                    near = np.concatenate([np.einsum("ij,ij->i", own[q[p : p + 65_536]], theirs[c[p : p + 65_536]]) for p in range(0, len(q), 65_536)] or [np.empty(0)]) >= floor[q]
                    q, c = q[near], c[near]
                    left.append(len(q))
            whole = q is None
            q, c = np.nonzero(other) if whole else (q, c)
        else:
            whole, (q, c) = True, np.nonzero(other)
        self.seen.append((pairs, left))
        if not len(q):
            return
        score = products(queries, candidates, q, c, whole)
        good = score >= self.least[q]
        self._keep(q[good], candidates.ids[c[good]], score[good])

    def _keep(self, q, c, score) -> None:
        q, c, score = np.r_[self.q, q], np.r_[self.c, c], np.r_[self.score, score]
        order = np.lexsort((c, -score, q))
        q, c, score = q[order], c[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < self.k
        self.q, self.c, self.score = q[top], c[top], score[top]
        full = place[top] == self.k - 1
        self.least[self.q[full]] = self.score[full]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products of floored, scaled vectors, ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows of another id and the same length. Rows without id and vectors that are
    null, empty or hold a null or non-finite component take no part. A repeated
    row is a candidate as often as it stands there, and one query; of an id with
    several vectors the least one asks. Any finite size counts exactly; a scaled
    component beyond a double, or a product beyond 64 bits, is an error that
    names the rows. An empty table gives no rows; other columns don't matter.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, 4096)
    rows = usable(vectors, vec_id, embedding, scale)
    asked = materialize(packed(rows.where(f"vec_id % {every} = 0").groupBy("vec_id").agg(F.min("v").alias("v")), "q", block_rows))
    groups = max(1, -(-asked.count() // GROUP))
    asked = asked.select("q", F.col("n").alias("qn"), F.col("ids").alias("q_ids"), F.col("x").alias("q_x")).repartition(groups)
    met = packed(rows, "c", block_rows).join(asked, how="cross")

    def of(ids: bytes, x: bytes, n: int) -> Block:
        return Block(np.frombuffer(ids, "<i8"), np.frombuffer(x, "<f8").reshape(-1, n))

    def run(batches):
        best: dict[int, Best] = {}
        last: tuple[int, Block | None] = (-1, None)
        for batch in batches:
            for r in batch.to_pylist():
                if r["n"] != r["qn"]:
                    continue
                if r["q"] not in best:
                    best[r["q"]] = Best(of(r["q_ids"], r["q_x"], r["n"]), k)
                if last[0] != r["c"]:
                    last = r["c"], of(r["ids"], r["x"], r["n"])
                best[r["q"]].add(last[1])
        for b in best.values():
            yield pa.RecordBatch.from_arrays([pa.array(b.queries.ids[b.q]), pa.array(b.c), pa.array(b.score)], names=["query_id", "vec_id", "score"])

    found = met.select("n", "ids", "x", "c", "q", "qn", "q_ids", "q_x").mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
