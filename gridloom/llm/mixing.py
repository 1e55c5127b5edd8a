"""Mixing sources to target weights by pivotal dependent rounding.

Size of a document: its words. Sources, ordered by code point with null last, weigh 1, 2, 3, repeating; their targets
share the total size by weight, no target over ``CAP`` times its source's size, the excess shared again by weight.
A document of a source with target t and size s is expected t / s times: the whole part of that for certain, the rest p
as the probability of one copy more.

Rounding. Two documents with fractional probabilities p, q and sizes a, b swap mass: p a + q b stays, and p and q move
until one of them is 0 or 1, in the direction that a fair draw weighted to keep both expectations picks. So a group of
documents is settled but for one, and the group's expected mass is kept up to that one document. A reduction tree
combines the groups: leaves are bounded buckets of documents of one source and one size class (a power of two), the next
level takes the leaves' residuals by source and class, again in bounded buckets until one is left for each, and the root
settles, of a source, each class's residual and ``RESERVE`` documents (64 classes at most) from the largest class down: the
one that its class leaves open has the pool of all smaller classes for a partner, which give or take the mass evenly. So what
is open in the end is about as small as the source's smallest document, and one draw by its probability settles it. Every document's expected copies stay
t / s through all levels, and a source ends within about that document's size of its target. Draws come from hashes of the
document id and ``seed``, so reruns agree whatever the partitioning is.

Defined cases: null text has size 0; documents of size 0 are taken 0 times and take no part; rows with equal doc_id,
source and size are settled as one (its mass is theirs together, and each is taken equally often), other rows with equal
doc_id on their own; a source of size 0 has target 0; an empty table gives an empty table; ``mix`` keeps the columns of
docs, and extra columns may have any names but those starting with ``__mix_``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import saved, text_of
from gridloom.llm.rules import n_words

#: A target is at most this many times its source's size.
CAP = 3
WEIGHTS = (1, 2, 3)
#: Rows of a leaf in the mean, and residuals of an inner bucket at most.
LEAF = 100
FANIN = 200
#: Documents of each source and size class that go to the root unsettled, to make up there for larger ones.
RESERVE = 16
NODE = "doc_id long, source string, size long, n long, whole int, p double, class int, bucket int, key long, open boolean, leaf boolean"


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> (source, source_size, target).

    The excess is shared in closed form. With sources in ascending order of size / weight, those before a point are held
    at ``cap`` times their size and the rest share what is left by weight; the point is the first whose source is not over
    its cap at the shares of the rest. That takes running sums over one row a source, no loop.
    """
    from pyspark.sql import Window

    ranked = sources.withColumn(
        "weight",
        F.element_at(
            F.array(*map(F.lit, WEIGHTS)),
            F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(WEIGHTS))) + 1,
        ).cast("double"),
    )
    up = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    held = (
        ranked.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("capped", F.coalesce(cap * F.sum("source_size").over(before), F.lit(0)).cast("double"))
        .withColumn("rest_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest_weight"))
        .withColumn("free", F.col("level") * F.col("weight") <= cap * F.col("source_size"))
    )
    # The shares rise up to the first source that is not over its cap and fall after it.
    final = held.withColumn("final", F.max(F.when(F.col("free"), F.col("level"))).over(whole))
    target = F.least(F.col("final") * F.col("weight"), (cap * F.col("source_size")).cast("double"))
    return final.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def draw(key: int, other: int) -> float:
    """A number in [0, 1) from two 64-bit keys."""
    x = (key * 0x9E3779B97F4A7C15 + other * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = ((x ^ (x >> 31)) * m) & 0xFFFFFFFFFFFFFFFF
    return (x ^ (x >> 33)) / 2.0**64


def settle(p: list[float], size: list[int], key: list[int]) -> tuple[list[float], int]:
    """Pivotal rounding in the given order: every p but one becomes 0 or 1; returns them and the place of that one (-1 if
    none is left)."""
    p = list(p)
    left = -1
    for k in range(len(p)):
        if p[k] <= 1e-12 or p[k] >= 1 - 1e-12:
            p[k] = float(p[k] > 0.5)
            continue
        if left < 0:
            left = k
            continue
        j, a, b = left, size[left], size[k]
        up = min((1 - p[j]) * a, p[k] * b)  # mass that j can take from k
        down = min(p[j] * a, (1 - p[k]) * b)  # mass that k can take from j
        move = up if draw(key[j], key[k]) * (up + down) < down else -down
        p[j] += move / a
        p[k] -= move / b
        open_ = [i for i in (j, k) if 1e-9 < p[i] < 1 - 1e-9]
        for i in (j, k):
            if i not in open_:
                p[i] = float(p[i] > 0.5)
        left = open_[0] if open_ else -1
    return p, left


def _level(pdf: pd.DataFrame) -> pd.DataFrame:
    """One node of the tree: rows of a bucket, in the order of their hashes."""
    pdf = pdf.sort_values(["key", "doc_id", "size"], kind="stable")
    kept = RESERVE if pdf["bucket"].iloc[0] == 0 and pdf["leaf"].iloc[0] else 0
    held, pdf = pdf.iloc[:kept].assign(bucket=-1), pdf.iloc[kept:]
    mass = (pdf["size"] * pdf["n"]).tolist()
    p, left = settle(pdf["p"].tolist(), mass, pdf["key"].tolist())
    still = [False] * len(p)
    if left >= 0:
        still[left] = True
    return pd.concat([held, pdf.assign(p=p, open=still)]).assign(leaf=False)


def settle_with_pools(p: np.ndarray, mass: np.ndarray, key: list[int], kind: np.ndarray) -> np.ndarray:
    """Every p 0 or 1: class by class in the given order, the one that a class leaves open swaps mass with all later classes.

    The pool's probabilities move by the same amount, up or down, so a fair draw keeps every expectation. A swap ends when the
    document or one of the pool is at 0 or 1; that one is settled. Without a pool, a draw by its probability settles it.
    """
    p = p.astype(np.float64).copy()
    for c in dict.fromkeys(kind.tolist()):
        own = np.flatnonzero(kind == c)
        settled, left = settle(p[own].tolist(), mass[own].tolist(), [key[i] for i in own])
        p[own] = settled
        if left < 0:
            continue
        j, turn, later = int(own[left]), 0, np.arange(own[-1] + 1, len(p))
        while 0 < p[j] < 1:
            turn -= 1
            pool = later[(p[later] > 0) & (p[later] < 1)]
            if not len(pool):
                p[j] = draw(key[j], turn) < p[j]
                break
            total = float(mass[pool].sum())
            up = min((1 - p[j]) * mass[j], p[pool].min() * total)  # mass that j can take from the pool
            down = min(p[j] * mass[j], (1 - p[pool].max()) * total)
            move = up if draw(key[j], turn) * (up + down) < down else -down
            p[j] += move / mass[j]
            p[pool] -= move / total
            p[np.abs(p) < 1e-9], p[np.abs(p - 1) < 1e-9] = 0.0, 1.0
    return p


def _root(pdf: pd.DataFrame) -> pd.DataFrame:
    """The residuals and reserve of a source."""
    pdf = pdf.sort_values(["class", "key", "doc_id", "size"], ascending=False, kind="stable")
    mass = (pdf["size"] * pdf["n"]).to_numpy(dtype=np.float64)
    p = settle_with_pools(pdf["p"].to_numpy(), mass, pdf["key"].tolist(), pdf["class"].to_numpy())
    return pdf.assign(p=p, open=False)


def rounded(rows: DataFrame, seed: int = 11) -> DataFrame:
    """rows (doc_id, source, size, n, whole, p) with p turned into 0 or 1, for rows with size > 0 and 0 < p < 1."""
    keyed = saved(
        rows.withColumn("class", F.floor(F.log2(F.col("size") * F.col("n"))).cast("int")).withColumn(
            "key", F.xxhash64(F.lit(seed), "doc_id", "size")
        ),
        "mix-rows",
    )
    # The number of buckets depends on the counts alone: it is the same for every partitioning.
    counts = keyed.groupBy(F.col("source").alias("s"), F.col("class").alias("c")).agg(F.count(F.lit(1)).alias("rows"))
    level = keyed.join(counts, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).select(
        *keyed.columns,
        F.pmod(F.xxhash64(F.lit(13), "key"), F.ceil(F.col("rows") / LEAF)).cast("int").alias("bucket"),
        F.lit(True).alias("open"),
        F.lit(True).alias("leaf"),
    )
    width = -(-(counts.agg(F.max("rows")).first()[0] or 0) // LEAF)
    names = [x.split()[0] for x in NODE.split(", ")]
    done = reserve = None
    while True:
        out = saved(level.select(*names).groupBy("source", "class", "bucket").applyInPandas(_level, NODE), "mix-level")
        settled, residual = out.where("NOT open"), out.where("open AND bucket >= 0")
        reserve = out.where("bucket < 0") if reserve is None else reserve
        done = settled if done is None else done.unionByName(settled)
        if width <= 1:
            break
        width = -(-width // FANIN)
        level = residual.withColumn("bucket", (F.col("bucket") / FANIN).cast("int"))
    return done.unionByName(residual.unionByName(reserve).groupBy("source").applyInPandas(_root, NODE))


def copies(docs: DataFrame, cap: int = CAP, seed: int = 11) -> DataFrame:
    """(doc_id, source, size, n, source_size, target, copies): n rows of docs are to be taken ``copies`` times each."""
    sized = saved(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            n_words(text_of()).alias("size"),
        )
        .groupBy("doc_id", "source", "size")
        .agg(F.count(F.lit(1)).alias("n")),
        "mix-sizes",
    )
    sources = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = saved(targets(sources, cap).withColumnRenamed("source", "s"), "mix-targets")
    same = F.col("source").eqNullSafe(F.col("s"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = sized.join(aims, same).select(
        "doc_id", "source", "size", "n", F.floor(ratio).cast("int").alias("whole"), (ratio - F.floor(ratio)).alias("p")
    )
    moving = (F.col("size") > 0) & (F.col("p") > 0)
    settled = rounded(aimed.where(moving), seed).select("doc_id", "source", "size", "n", "whole", "p")
    every = settled.unionByName(aimed.where(~moving))
    taken = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + F.col("p").cast("int"))
    return every.join(aims, same).select(
        "doc_id", "source", "size", "n", "source_size", "target", taken.cast("int").alias("copies")
    )


def mix(docs: DataFrame, cap: int = CAP) -> DataFrame:
    """docs with each row as many times as the mix takes it: not at all, once or more."""
    names = docs.columns
    decided = copies(docs, cap).select(
        F.col("doc_id").alias("__mix_id"), F.col("source").alias("__mix_source"), F.col("size").alias("__mix_size"),
        F.col("copies").alias("__mix_copies"),
    ).where("__mix_copies > 0")
    same = (
        F.col("doc_id").cast("long").eqNullSafe(F.col("__mix_id"))
        & F.col("source").cast("string").eqNullSafe(F.col("__mix_source"))
        & (n_words(text_of()) == F.col("__mix_size"))
    )
    repeated = docs.join(decided, same).withColumn("__mix_no", F.explode(F.sequence(F.lit(1), "__mix_copies")))
    return repeated.select(*(F.col(f"`{c}`") for c in names))


def op7_mix(docs: DataFrame) -> DataFrame:
    rows = copies(docs).withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )
