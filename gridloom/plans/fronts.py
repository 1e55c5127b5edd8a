"""Fronts through graphs that no task holds whole: blocks are solved apart, and tell their neighbours the times at their borders.

A block's solver takes times of vertices beside it (``ghosts``) as given. Blocks with sources begin; a block whose ghosts have
changed is solved again, until no border changes. Times never depend on later ones, so what is settled then is what one solver
over the whole graph finds. A task holds one block, whatever the size of a component; rounds are as many as the blocks that a
front crosses one after the other.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Callable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.grid import block_id
from gridloom.functions.store import shared_folder, stored

#: Vertices of a block at most.
SIZE = 1 << 17
#: Blocks that are named in a filter; of more, all are read.
NAMED = 500
NOTES = "run long, block long, to long, data binary"
#: Where a run's values at asked vertices go: to no block.
ASKED = -1
#: The run of sources that the blocks know themselves; other runs start at the vertex of that id.
OWN = -1


def note(ids: np.ndarray, times: np.ndarray) -> bytes:
    return ids.astype(np.int64).tobytes() + times.astype(np.float64).tobytes()


def noted(data: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and times (``width`` numbers each) of several notes."""
    cut = [len(d) // (1 + width) for d in data]
    ids = [np.frombuffer(d[:c], np.int64) for d, c in zip(data, cut, strict=True)]
    times = [np.frombuffer(d[c:], np.float64) for d, c in zip(data, cut, strict=True)]
    return np.concatenate([np.zeros(0, np.int64), *ids]), np.concatenate([np.zeros(0), *times]).reshape(-1, width)


def by_block(df: DataFrame) -> DataFrame:
    """df (block, ...) written in a folder for each block, so that a round reads the blocks it solves alone."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy("block").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _latest(notes: DataFrame) -> DataFrame:
    return notes.groupBy("run", "block", "to").agg(F.max_by("data", "round").alias("data"), F.max("round").alias("round"))


def _named(active: list[int], *columns: str):
    """Is one of the columns a block of these?"""
    if len(active) > NAMED:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out |= F.col(c).isin(active)
    return out


def _solved(blocks: DataFrame, todo: DataFrame, notes: DataFrame | None, work: Callable, schema: str, active: list[int], units: int, width: int, k: int = 0) -> DataFrame:
    """Rows of work(data, block, run, ghosts, fresh, old) for each of todo (run, block): what its neighbours told it, what of it
    they told in the round before by sender, and the notes that the block has sent by receiver."""
    spark = blocks.sparkSession
    rows = todo.select("block", "run", F.lit(0).alias("kind"), F.lit(ASKED).cast("long").alias("to"), F.lit(None).cast("binary").alias("data"))
    if notes is not None:
        last = _latest(notes.where(_named(active, "block", "to")))
        at = todo.select(F.col("run").alias("r"), F.col("block").alias("b"))
        ghosts = last.join(at, (F.col("run") == F.col("r")) & (F.col("to") == F.col("b"))).select("b", "run", F.when(F.col("round") == k - 1, 3).otherwise(1), "block", "data")
        sent = last.join(at, (F.col("run") == F.col("r")) & (F.col("block") == F.col("b"))).select("b", "run", F.lit(2), "to", "data")
        rows = rows.union(ghosts).union(sent)
    # Runs of one block are dealt to several tasks where there are fewer blocks than tasks.
    deal = max(1, min(-(-units // max(1, len(active))), -(-2 * spark.sparkContext.defaultParallelism // max(1, len(active)))))
    parts = min(4000, 4 * len(active) * deal)
    left = rows.withColumn("deal", F.pmod(F.xxhash64("run"), F.lit(deal)).cast("int")).repartition(parts, "block", "deal")
    right = blocks.where(_named(active, "block")).select("block", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))).alias("deal"), "data")
    right = right.repartition(parts, "block", "deal")

    def run(key, units_: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(units_) and len(own):
            data = pickle.loads(own["data"].iloc[0])
            for name, rows_ in units_.groupby("run"):
                near = noted(rows_.loc[rows_["kind"] % 2 == 1, "data"].tolist(), width)
                fresh, old = ({to: noted([d], width) for to, d in rows_.loc[rows_["kind"] == kind, ["to", "data"]].itertuples(index=False)} for kind in (3, 2))
                found.append(work(data, int(key[0]), int(name), near, fresh, old))
        return pd.concat(found) if found else pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})

    return left.groupBy("block", "deal").cogroup(right.groupBy("block", "deal")).applyInPandas(run, schema)


def settled(blocks: DataFrame, begin: DataFrame, solve: Callable, width: int = 1, idle: Callable | None = None) -> DataFrame | None:
    """Notes (run, block, to, data) of the settled fronts that start at begin (run, block); None if nothing was sent.

    blocks: (block, data) with data a pickled dict that has ``ids`` (sorted), ``border`` [(block, places in ids)] and what
    solve(data, run, ghosts) needs, which gives the times at ids: ``width`` numbers each, the first one inf where no front comes. idle(data, fresh,
    old): is it certain that these news change nothing? Only for solvers whose times fall when their ghosts' do."""
    spark = blocks.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"

    def work(data, block, run, ghosts, fresh, old):
        if idle is not None and fresh and idle(data, fresh, old):
            return pd.DataFrame(columns=["run", "block", "to", "data"])
        times = solve(data, run, ghosts).reshape(-1, width)
        out = []
        for to, places in data["border"]:
            some = places[np.isfinite(times[places, 0])]
            now = note(data["ids"][some], times[some])
            if now != note(*old.get(to, noted([], width))):
                out.append((run, block, to, now))
        return pd.DataFrame(out, columns=["run", "block", "to", "data"])

    todo, k = stored(begin.select("run", "block").distinct()), 0
    notes = None
    while True:
        counts = todo.groupBy("block").count().collect()  # one row a block
        if not counts:
            return None if notes is None else _latest(notes).drop("round")
        _solved(blocks, todo, notes, work, NOTES, [r[0] for r in counts], sum(r[1] for r in counts), width, k).write.parquet(f"{path}/round={k}")
        notes = spark.read.schema(NOTES + ", round int").parquet(path)
        todo = notes.where((F.col("round") == k) & (F.col("to") != ASKED)).select("run", F.col("to").alias("block")).distinct()
        k += 1


def results(blocks: DataFrame, notes: DataFrame | None, finish: Callable, schema: str, width: int = 1) -> DataFrame:
    """Rows of finish(data, ghosts) of every block, its own sources' front settled."""
    todo = stored(blocks.select(F.lit(OWN).cast("long").alias("run"), "block"))
    active = [r[0] for r in todo.select("block").collect()]  # one row a block
    last = None if notes is None else notes.where(F.col("run") == OWN).withColumn("round", F.lit(0))
    return _solved(blocks, todo, last, lambda data, block, run, ghosts, fresh, old: finish(data, ghosts), schema, active, len(active), width)


def asked_times(notes: DataFrame | None, spark: SparkSession) -> DataFrame:
    """(from, to, distance) of the vertices that blocks name in their border to ``ASKED``."""
    schema = "from long, to long, distance double"

    def run(batches):
        for pdf in batches:
            for name, data in zip(pdf["run"].tolist(), pdf["data"], strict=True):
                ids, times = noted([data], 1)
                yield pd.DataFrame({"from": name, "to": ids, "distance": times[:, 0]})

    if notes is None:
        return spark.createDataFrame([], schema)
    return notes.where(F.col("to") == ASKED).select("run", "data").mapInPandas(run, schema)


class Grid:
    """Blocks of a grid, each with a rim of one pixel as a flat array: a step to a neighbour is a stride."""

    def __init__(self, shape, connectivity: int, size: int | None = None):
        self.shape = tuple(shape)
        block = list(shape)
        while math.prod(block) > (size or SIZE):
            k = int(np.argmax(block))
            block[k] = -(-block[k] // 2)
        self.block = tuple(block)
        self.steps = [o for o in product((-1, 0, 1), repeat=3) if 0 < sum(map(abs, o)) <= connectivity and all(n > 1 or not d for d, n in zip(o, shape, strict=True))]
        self.pad = tuple(int(n > 1) for n in shape)
        self.size = tuple(b + 2 * p for b, p in zip(block, self.pad, strict=True))
        self.strides = (self.size[1] * self.size[2], self.size[2], 1)
        self.margin = sum(s for s, p in zip(self.strides, self.pad, strict=True) if p)
        self.cells = math.prod(self.size) + 2 * self.margin

    def block_of(self, z, y, x):
        return block_id(z, y, x, self.shape, self.block)

    def split(self, ids: np.ndarray) -> list[np.ndarray]:
        _, h, w = self.shape
        return [ids // (h * w), ids // w % h, ids % w]

    def blocks_at(self, at: list[np.ndarray]) -> np.ndarray:
        per = [-(-n // b) for n, b in zip(self.shape, self.block, strict=True)]
        z, y, x = (c // b for c, b in zip(at, self.block, strict=True))
        return (z * per[1] + y) * per[2] + x

    def places(self, block: int, ids: np.ndarray) -> np.ndarray:
        """Where pixels of a block and its rim are in its flat array; in the order of their ids."""
        per = [-(-n // b) for n, b in zip(self.shape, self.block, strict=True)]
        first = [block // (per[1] * per[2]) * self.block[0], block // per[2] % per[1] * self.block[1], block % per[2] * self.block[2]]
        return self.margin + sum((c - f + p) * s for c, f, p, s in zip(self.split(ids), first, self.pad, self.strides, strict=True))

    def stride(self, step) -> int:
        return sum(d * s for d, s in zip(step, self.strides, strict=True))

    def border(self, block: int, ids: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The blocks that a step leads to from a block's pixels, each with the places of these pixels in ids."""
        at = self.split(ids)
        to, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for o in self.steps:
            there = [c + d for c, d in zip(at, o, strict=True)]
            good = np.logical_and.reduce([(c >= 0) & (c < n) for c, n in zip(there, self.shape, strict=True)])
            found = self.blocks_at(there)
            some = np.flatnonzero(good & (found != block))
            to.append(found[some])
            place.append(some)
        pairs = np.unique(np.stack([np.concatenate(to), np.concatenate(place)], axis=1), axis=0)
        return [(int(b), pairs[pairs[:, 0] == b, 1]) for b in np.unique(pairs[:, 0])]

    def idle(self, data: dict, fresh: dict, old: dict) -> bool:
        """Do fresh times come after those of all pixels beside them?"""
        beside = np.full(self.cells, -np.inf)
        beside[self.places(data["block"], data["ids"])] = np.inf
        for to in fresh:
            if to in old:
                beside[self.places(data["block"], old[to][0])] = old[to][1][:, 0]
        for ids, times in fresh.values():
            at = self.places(data["block"], ids)
            if any((beside[at + self.stride(o)] >= times[:, 0]).any() for o in self.steps):
                return False
        return True

    def packed(self, pixels: DataFrame, columns: tuple[str, ...]) -> DataFrame:
        """(block, has, data) of pixels (node_id, z, y, x, *columns): data has ids, border and the columns; has: is one a source?"""
        named = pixels.select(self.block_of(F.col("z"), F.col("y"), F.col("x")).alias("block"), F.col("node_id").cast("long").alias("node_id"), *columns)

        def pack(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("node_id")
            ids = pdf["node_id"].to_numpy()
            data = {"block": int(key[0]), "ids": ids, "border": self.border(int(key[0]), ids)} | {c: pdf[c].to_numpy() for c in columns}
            if "asked" in columns:
                data["border"].append((ASKED, np.flatnonzero(data["asked"])))
            has = bool(pdf["source"].any()) if "source" in columns else False
            return pd.DataFrame({"block": [key[0]], "has": [has], "data": [pickle.dumps(data)]})

        return by_block(named.groupBy("block").applyInPandas(pack, "block long, has boolean, data binary"))


def sources(blocks: DataFrame) -> DataFrame:
    return blocks.where("has").select(F.lit(OWN).cast("long").alias("run"), "block")
