"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are sorted by length and cut into buckets of at most ``BUCKET`` rows, up to ``GROUP`` of which travel together. Each
query starts with a threshold: its k-th best score among the ``SEEDS`` longest vectors, a bounded set. Against a bucket whose
longest vector has length L, a query q with threshold t needs a cosine of t / (|q| L) or more. Where that is over 1 the bucket
and all after it are passed over; where it is ``COSINE`` or more, coordinate pruning keeps the rows whose normalized values at
the query's largest coordinates lie in the range that such a cosine allows; else length pruning keeps the rows of length
t / |q| or more. The rows that stay are verified by their integer products, and raise the threshold for the buckets after them.

Queries travel in blocks of similar t / |q|, which is the length that a vector needs. Groups are put on at most ``LEVELS``
levels by the length of their longest vector; a block is sent to the groups of the levels that reach the least length that
one of its queries needs, each once, by an equi-join on level and place, and to no others. Every (query, group) pair sends on
k rows at most; the best k of a query are ranked at the end, with a limit before the shuffle.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, neither as queries nor as
candidates; a vector's candidates are those of as many components as its own and of another vec_id; ties go to the
smaller vec_id; fewer than k candidates give fewer rows; repeated rows are candidates of their own; an empty table gives
an empty table. Products must fit 64-bit integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import saved

BUCKET = 4096
QUERY_BLOCK = 512
#: Longest vectors that give the first thresholds: at most so many rows and bytes.
SEEDS = 4096
SEED_BYTES = 4 << 20
COSINE = 0.4
FOCUS = 4
#: Buckets that travel together, and their bytes at most.
GROUP, GROUP_BYTES = 4, 16 << 20
#: Levels of group lengths, by which groups out of a block's reach are known, at most.
LEVELS = 256
SLACK = 1e-9


def quantized(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v array<long>, norm2, dim) of the vectors that take part."""
    x = F.col("embedding")
    good = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ints = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), ints.alias("v")).withColumns(
        {
            "norm2": F.aggregate("v", F.lit(0).cast("double"), lambda a, c: a + c.cast("double") * c.cast("double")),
            "dim": F.size("v"),
        }
    )


def exact(a: np.ndarray, b: np.ndarray, big: float) -> np.ndarray:
    """Integer products of rows; by floating point where that is exact."""
    if big < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score descending, id ascending)."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= cut)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def matrix(batch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    return column.values.to_numpy(), column.offsets.to_numpy()


BLOCK = "no long, dim int, ids binary, data binary, norms binary, t binary, edge double"


def blocks(rows: DataFrame, size: int, queries: bool = False) -> DataFrame:
    """Rows (vec_id, v, norm2, dim, t) in their order as blocks, each of one dim and sorted by length. ``edge`` is the largest
    length of a block, or, of a block of queries, the least length that one of them needs of a vector."""

    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def block(dim, rows_):
            nonlocal seq
            seq += 1
            ids = np.array([r[0] for r in rows_], dtype=np.int64)
            data = np.array([r[1] for r in rows_], dtype=np.int64).reshape(len(rows_), dim)
            norms = np.sqrt(np.array([r[2] for r in rows_], dtype=np.float64))
            t = np.array([r[3] for r in rows_], dtype=np.float64)
            order = np.argsort(-norms, kind="stable")
            edge = float(needed(t, norms).min() if queries else norms.max())
            return pa.RecordBatch.from_pydict(
                {
                    "no": pa.array([part * 1_000_003 + seq], pa.int64()), "dim": pa.array([dim], pa.int32()),
                    "ids": [ids[order].tobytes()], "data": [data[order].tobytes()], "norms": [norms[order].tobytes()],
                    "t": [t[order].tobytes()], "edge": [edge],
                }
            )

        for batch in batches:
            ids, norm2, dims, t = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 2, 3, 4))
            values, ends = matrix(batch, "v")
            for k in range(batch.num_rows):
                dim = int(dims[k])
                rows_ = held.setdefault(dim, [])
                rows_.append((ids[k], values[ends[k] : ends[k + 1]], norm2[k], t[k]))
                if len(rows_) >= min(size, max(BUCKET // 64, GROUP_BYTES // (8 * max(dim, 1)))):
                    yield block(dim, held.pop(dim))
        for dim, rows_ in held.items():
            yield block(dim, rows_)

    return rows.select("vec_id", "v", "norm2", "dim", "t").mapInArrow(run, BLOCK)


def needed(t: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The least length of a vector whose product with a query can be t; -inf where there is no such bound."""
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where((t > 0) & (norms > 0), t / norms * (1 - SLACK), -np.inf)
    return np.where(np.isnan(t), -np.inf, need)


def search_bucket(q, q_norm, q_id, t, data, norms, ids, k, big):
    """The best k of a bucket for one query with threshold t (None: none yet), as (ids, scores)."""
    stop = len(ids)
    if t is not None and q_norm > 0 and len(norms):
        need = t / q_norm
        cosine = need / norms[0] if norms[0] > 0 else np.inf
        if cosine > 1 + SLACK:
            return None
        if cosine >= COSINE:
            # Rows of length L need cosine t / (|q| L); the bucket's bound is right for all of them.
            c = min(cosine, 1.0)
            focus = np.argsort(-np.abs(q))[:FOCUS]
            x = q[focus] / q_norm
            spread = np.sqrt(max(0.0, 1 - c * c)) * np.sqrt(np.maximum(0.0, 1 - x * x))
            # A unit vector with x·y >= c has y_f >= x_f c - spread and y_f <= x_f c + spread, where the other side of
            # the peak (x_f beyond c) reaches up to 1.
            low = np.where(-x > c, -1.0, x * c - spread) - 1e-7
            high = np.where(x > c, 1.0, x * c + spread) + 1e-7
            y = data[:, focus] / np.maximum(norms, 1e-300)[:, None]
            rows = np.flatnonzero(((y >= low) & (y <= high)).all(axis=1))
        else:
            stop = int(np.searchsorted(-norms, -need * (1 - SLACK), side="right")) if need > 0 else len(ids)
            rows = np.arange(stop)
    else:
        rows = np.arange(stop)
    rows = rows[ids[rows] != q_id]
    if not len(rows):
        return None
    score = exact(q[None, :], data[rows], big)[0]
    if t is not None:
        good = score >= t
        rows, score = rows[good], score[good]
    top = best(score, ids[rows], k)
    return ids[rows[top]], score[top]


def search_group(q, q_norm, q_id, t, data, norms, ids, k, big):
    """The best k of a group for one query, bucket by bucket, the threshold rising; as (ids, scores), or None."""
    held = None
    for start in range(0, len(ids), BUCKET):
        if t is not None and q_norm > 0 and t / q_norm > norms[start] * (1 + SLACK):
            break
        own = slice(start, start + BUCKET)
        found = search_bucket(q, q_norm, q_id, t, data[own], norms[own], ids[own], k, big)
        if found is None:
            continue
        if held is not None:
            found = np.concatenate([held[0], found[0]]), np.concatenate([held[1], found[1]])
            top = best(found[1], found[0], k)
            found = found[0][top], found[1][top]
        held = found
        if len(held[0]) == k and (t is None or held[1][-1] > t):
            t = float(held[1][-1])
    return held


def with_thresholds(queries: DataFrame, seeds: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """queries and t, their k-th best score among the seeds of their dim (null if there are fewer), and need."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                q_ids, norm2, dims = (batch.column(c).to_numpy() for c in (0, 2, 3))
                lists = batch.column(1).to_pylist()
                t = np.full(batch.num_rows, np.nan)
                for dim in set(dims.tolist()) & set(seeds):
                    own = np.flatnonzero(dims == dim)
                    q = np.array([lists[j] for j in own], dtype=np.int64).reshape(len(own), dim)
                    ids, data = seeds[dim]
                    big = float(np.abs(q).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(dim, 1)
                    score = exact(q, data, big)
                    for j, row in zip(own, score, strict=True):
                        others = row[ids != q_ids[j]]
                        if len(others) >= k:
                            t[j] = np.partition(others, len(others) - k)[len(others) - k]
                need = pa.array(needed(t, np.sqrt(norm2)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t), need], [*batch.schema.names, "t", "need"])

    return queries.select("vec_id", "v", "norm2", "dim").mapInArrow(
        run, "vec_id long, v array<long>, norm2 double, dim int, t double, need double"
    )


def paired(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Blocks of queries (columns q_*) with each group of vectors that may be long enough for one of them."""
    groups = max(1, stored.count())
    levels = min(LEVELS, groups)
    places = -(-groups // levels)
    cuts = [F.lit(1 - x / levels) for x in range(levels + 1)]
    # One row of at most LEVELS + 1 lengths for each number of components.
    edges = F.broadcast(
        stored.groupBy(F.col("dim").alias("d")).agg(F.percentile_approx("edge", F.array(*cuts), 10_000).alias("cuts"), F.max("edge").alias("top"))
        .select("d", F.array_distinct(F.concat(F.array("top"), "cuts")).alias("cuts"))
    )
    # A group is on the level of the number of cuts above its length; a block goes as far as the cuts reach what it needs.
    right = stored.join(edges, F.col("dim") == F.col("d")).select(
        "dim", "ids", "data", "norms", F.size(F.filter("cuts", lambda c: c > F.col("edge"))).alias("level"),
        F.pmod(F.xxhash64("no"), F.lit(places)).cast("int").alias("place"),
    )
    last = F.size(F.filter("cuts", lambda c: c >= F.col("edge")))
    left = (
        asked.join(edges, F.col("dim") == F.col("d"))
        .withColumn("last", last).where("last > 0")
        .withColumn("q_level", F.explode(F.sequence(F.lit(0), "last")))
        .withColumn("q_place", F.explode(F.sequence(F.lit(0), F.lit(places - 1))))
        .select(*(F.col(c).alias(f"q_{c}") for c in ("dim", "ids", "data", "norms", "t")), "q_level", "q_place")
    )
    same = (F.col("q_dim") == F.col("dim")) & (F.col("q_level") == F.col("level")) & (F.col("q_place") == F.col("place"))
    return left.join(right, same)


def top_products(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of vectors for each of queries, both as from ``quantized``."""
    widest = vectors.agg(F.max("dim")).first()[0] or 1
    n = int(max(k + 1, min(SEEDS, SEED_BYTES // (8 * widest))))
    seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    rows = vectors.orderBy(F.col("norm2").desc(), "vec_id").limit(n).select("vec_id", "v", "dim").collect()  # n rows at most
    for dim in {r["dim"] for r in rows}:
        own = [r for r in rows if r["dim"] == dim]
        data = np.array([r["v"] for r in own], dtype=np.int64).reshape(len(own), dim)
        seeds[dim] = (np.array([r["vec_id"] for r in own]), data)

    longest = (F.col("norm2").desc(), F.col("vec_id"))
    ordered = vectors.withColumn("t", F.lit(None).cast("double")).repartitionByRange(*longest).sortWithinPartitions(*longest)
    stored = saved(blocks(ordered, BUCKET * GROUP), "mips-groups")
    hardest = (F.col("need").desc(), F.col("vec_id"))
    of_queries = with_thresholds(queries, seeds, k).repartitionByRange(*hardest).sortWithinPartitions(*hardest)
    asked = saved(blocks(of_queries, QUERY_BLOCK, queries=True), "mips-queries")

    def search(batches):
        for batch in batches:
            for one in range(batch.num_rows):
                row = batch.slice(one, 1).to_pylist()[0]
                dim = row["dim"]
                q = np.frombuffer(row["q_data"], dtype=np.int64).reshape(-1, dim)
                q_ids, q_norms = np.frombuffer(row["q_ids"], dtype=np.int64), np.frombuffer(row["q_norms"])
                t = np.frombuffer(row["q_t"])
                data = np.frombuffer(row["data"], dtype=np.int64).reshape(-1, dim)
                ids, norms = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["norms"])
                big = float(np.abs(q).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(dim, 1)
                out_q, out_v, out_s = [], [], []
                for j in range(len(q)):
                    found = search_group(q[j], q_norms[j], q_ids[j], None if np.isnan(t[j]) else t[j], data, norms, ids, k, big)
                    if found is not None:
                        out_q.append(np.full(len(found[0]), q_ids[j]))
                        out_v.append(found[0])
                        out_s.append(found[1])
                if out_q:
                    yield pa.RecordBatch.from_pydict(
                        {"query_id": np.concatenate(out_q), "vec_id": np.concatenate(out_v), "score": np.concatenate(out_s)}
                    )

    pairs = paired(asked, stored)
    found = pairs.select("q_data", "q_ids", "q_norms", "q_t", "dim", "data", "ids", "norms").mapInArrow(
        search, "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op6_topk(vectors: DataFrame) -> DataFrame:
    v = saved(quantized(vectors), "mips-vectors")
    return top_products(v.where("vec_id % 50 = 0"), v)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
) WHERE rank <= 5
"""
