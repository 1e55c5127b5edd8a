"""Quality classifier: naive Bayes support vectors.

Features of a text are indicators of hashed n-grams (one and two tokens). Tokens are a word's letters, its closing or
opening punctuation and its shape, so that rare words still share features; the share of words that repeat one of the two before
them counts as so many features. Fit: every feature's log-count ratio between
the classes, from the indicator counts of all training rows (smoothed); the indicators, scaled by the ratios, go into a
linear model with hinge loss, fitted by dual coordinate descent; its margins on the sample are turned into scores by a
logistic curve. The counts are summed within each task, then by ranges of features (``RANGE`` each). Only the descent and
the curve take a sample, in the order of the ids' hashes: ``FIT_ROWS`` labelled rows at most, and no row more once they have
``FIT_FEATURES`` features together. Tasks turn its texts into features, one task reads these in that order and fits.

Defined cases: null text is the empty text, which has the feature of an empty text alone and gets a score like any other;
texts of any length are read whole; repeated rows get equal scores; rows with null doc_id are held out; with labels of
one class or none, every score is that class's share (0.5 for none); an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import pickle
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import own_cache, slices, text_bytes, text_of

#: Hash buckets of the n-grams: the model's size, whatever the corpus.
BITS = 18
DIM = 1 << BITS
#: Labelled rows of a fit at most, and the features of these rows from which on none is added, whatever its length.
FIT_ROWS = 6_000
FIT_FEATURES = 12_000_000
#: Features whose counts are one row on their way from the tasks that count to those that sum.
RANGE = 1 << 9
SMOOTH = 1.0
COST = 0.1
EPOCHS = 30
SLICE_BYTES = 1_500_000
CACHE_MAX = 250_000
MIX = np.uint64(0x9E3779B97F4A7C15)
PART = re.compile(r"^(\W*)(.*?)(\W*)$", re.DOTALL)

def _hash(text: str) -> int:
    data = text.encode()
    return zlib.crc32(data) << 31 ^ zlib.adler32(data) ^ len(data) << 20


def word_codes(word: str) -> tuple[int, ...]:
    """Hashes of a word's tokens."""
    before, core, after = PART.match(word).groups()
    shape = "U" if len(core) > 1 and core.isupper() else "T" if core.istitle() else "l" if core.islower() else "d" if core.isdigit() else "x"
    out = [_hash("w" + core.lower()), _hash("s" + shape + before[:8] + "_" + after[:8])]
    return tuple(out)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ends, ids): distinct features of each text, ids[ends[k]:ends[k + 1]]."""
    cut = [t.split() for t in texts]
    words = set(chain.from_iterable(cut))
    codes = own_cache("classify", CACHE_MAX)
    codes = own_cache("classify", CACHE_MAX, len(words.difference(codes)))
    for w in words.difference(codes):
        codes[w] = word_codes(w)
    n = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
    flat = np.fromiter(
        chain.from_iterable(map(codes.__getitem__, chain.from_iterable(cut))), dtype=np.uint64, count=int(n.sum()) * 2
    ).reshape(-1, 2)
    doc = np.repeat(np.arange(len(cut), dtype=np.uint64), n)
    w, s = flat[:, 0], flat[:, 1]
    pair = doc[1:] == doc[:-1]
    parts, owner = [w, s], [doc, doc]
    if len(w) > 1:
        parts += [(w[:-1] * MIX + w[1:])[pair], (s[:-1] * MIX + s[1:] + np.uint64(1))[pair]]
        owner += [doc[1:][pair]] * 2
        # How many of a text's words equal one of the two before, in percent, as that many features.
        like = np.append(False, (w[1:] == w[:-1]) & pair)
        like[2:] |= (w[2:] == w[:-2]) & (doc[2:] == doc[:-2])
        percent = np.bincount(doc[like].astype(np.int64), minlength=len(cut)) * 100 // np.maximum(n, 1)
        owner.append(np.repeat(np.arange(len(cut), dtype=np.uint64), percent))
        parts.append((np.arange(int(percent.sum())) - np.repeat(np.cumsum(percent) - percent, percent) + 1000).astype(np.uint64))
    parts.append(np.where(n == 0, 5, 6).astype(np.uint64))  # an empty text, or not
    owner.append(np.arange(len(cut), dtype=np.uint64))
    ids = (np.concatenate(parts) * MIX) >> np.uint64(64 - BITS)
    keys = np.concatenate(owner) << np.uint64(BITS) | ids
    keys = keys.astype(np.uint32) if len(cut) <= 1 << (32 - BITS) else keys
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    ends = np.searchsorted(keys, (np.arange(len(cut) + 1, dtype=np.uint64) << np.uint64(BITS)).astype(np.uint64))
    return ends, (keys & keys.dtype.type(DIM - 1)).astype(np.int64)


def descend(ends: np.ndarray, ids: np.ndarray, y: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of the L2-regularized hinge-loss model, by dual coordinate descent over rows."""
    n = len(y)
    # Rows are scaled to unit length, so a long text weighs as much as a short one.
    norm = np.array([np.sqrt((scale[ids[a:b]] ** 2).sum()) + 1e-9 for a, b in zip(ends[:-1], ends[1:], strict=True)])
    rows = [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    values = [scale[r] / z for r, z in zip(rows, norm, strict=True)]
    w, bias = np.zeros(DIM), 0.0
    # Each class has half of the cost.
    upper = np.where(y > 0, n / (2.0 * max(1, (y > 0).sum())), n / (2.0 * max(1, (y < 0).sum()))) * COST * 10
    alpha = np.zeros(n)
    rng = np.random.default_rng(5)
    for _ in range(EPOCHS):
        moved = 0.0
        for k in rng.permutation(n):
            r, v = rows[k], values[k]
            g = y[k] * (w[r] @ v + bias) - 1.0
            new = min(max(alpha[k] - g / 2.0, 0.0), upper[k])  # |x|² + 1 for the bias
            step = new - alpha[k]
            if step:
                alpha[k] = new
                w[r] += step * y[k] * v
                bias += step * y[k]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return np.append(w, bias)


class Model:
    def __init__(self, scale: np.ndarray, weights: np.ndarray, slope: float, shift: float):
        self.scale = scale.astype(np.float32)
        self.weights = (weights[:-1] * scale).astype(np.float32)
        self.bias, self.slope, self.shift = float(weights[-1]), slope, shift

    def margins(self, texts: list[str]) -> np.ndarray:
        ends, ids = features(texts)
        owner = np.repeat(np.arange(len(texts)), np.diff(ends))
        top = np.bincount(owner, weights=self.weights[ids], minlength=len(texts))
        norm = np.sqrt(np.bincount(owner, weights=self.scale[ids].astype(np.float64) ** 2, minlength=len(texts)))
        return top / (norm + 1e-9) + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margins(texts) + self.shift, -30, 30)))


def curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of y on margin (Newton's method, with Platt's targets)."""
    hi, lo = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (hi + 1) / (hi + 2), 1 / (lo + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = p - t, p * (1 - p) + 1e-9
        g = np.array([(d * margin).sum() + 1e-3 * (a - 1), d.sum()])
        m = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum()]])
        step = np.linalg.solve(m + 1e-6 * np.eye(2), g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def held_out(doc_id):
    """crc32 of the decimal doc_id, modulo 3, is 1; null doc_ids are held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, most: int = FIT_FEATURES) -> bytes:
    """A pickled model from docs (doc_id, text) and labels (doc_id, label): counts of all labels with label 0 or 1, descent
    on at most ``rows`` of them, those of the least hashes. Tasks send on their counts of ranges of features and, of the
    sample, the feature ids; both reach the one task that fits, ``DIM`` counts of each class and the sample, whatever the
    corpus."""
    known = (
        labels.where("label IN (0, 1) AND doc_id IS NOT NULL")
        .select(F.col("doc_id").cast("long").alias("id"), F.col("label").cast("int").alias("label"))
        .withColumn("key", F.xxhash64(F.lit(23), "id"))
    )
    # The sample's last label in order: those up to it are the sample.
    order = F.struct("key", "id", "label")
    last = known.orderBy("key", "id", "label").limit(rows).agg(F.max(order)).first()[0]
    if last is None:
        return pickle.dumps(0.5)
    known = known.withColumn("sampled", order <= F.struct(*(F.lit(last[n]).cast(known.schema[n].dataType).alias(n) for n in ("key", "id", "label"))))
    # Labels grow with the corpus, so they are never sent to all tasks.
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(
        known.hint("merge"), F.col("doc_id") == F.col("id")
    )

    def learn(batches):
        """Rows of the sample (part null), then this task's counts by range of features (part)."""
        count, n = np.zeros((2, DIM), dtype=np.int64), [0, 0]
        for batch in slices(batches, text_bytes("text"), SLICE_BYTES):
            ends, ids = features(batch.column(2).to_pylist())
            label = batch.column(1).to_numpy()
            owner = np.repeat(label, np.diff(ends))
            for c in (0, 1):
                count[c] += np.bincount(ids[owner == c], minlength=DIM)
                n[c] += int((label == c).sum())
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            kept = pa.RecordBatch.from_pydict(
                {"part": pa.nulls(len(label), pa.int32()), "key": batch.column(0), "label": batch.column(1), "ids": lists, "counts": pa.nulls(len(label), pa.binary())}
            )
            yield kept.filter(batch.column(3))
        if sum(n):
            yield counted(count, np.array(n))

    def add(batches):
        """Sums of the counts of each part; rows of the sample as they are."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            of_sample = pc.is_null(batch.column(0))
            yield batch.filter(of_sample)
            rest = batch.filter(pc.invert(of_sample))
            for part, data in zip(rest.column(0).to_pylist(), rest.column(4).to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(zlib.decompress(data), dtype=np.int64)
        yield count_rows(sums)

    def train(batches):
        kept: list[tuple[int, np.ndarray]] = []
        total = 0
        count, n = np.zeros((2, DIM), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for batch in batches:
            column = batch.column(3)
            flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
            named = zip(*(batch.column(c).to_pylist() for c in (0, 2, 4)), strict=True)
            for k, (part, label, data) in enumerate(named):
                if part is None:
                    if total < most:
                        kept.append((label, flat[ends[k] : ends[k + 1]].copy()))
                        total += ends[k + 1] - ends[k]
                    continue
                values = np.frombuffer(zlib.decompress(data), dtype=np.int64)
                if part < 0:
                    n += values
                else:
                    count[:, part * RANGE : (part + 1) * RANGE] += values.reshape(2, -1)
        y = np.array([1.0 if label else -1.0 for label, _ in kept])
        if len(set(y.tolist())) < 2:
            model: Model | float = float((y > 0).mean()) if len(y) else 0.5
        else:
            model = fitted(y, [ids for _, ids in kept], count, n)
        yield pa.RecordBatch.from_pydict({"model": pa.array([zlib.compress(pickle.dumps(model), 1)], pa.binary())})

    schema = "part int, key long, label int, ids array<int>, counts binary"
    coded = joined.select("key", "label", "text", "sampled").mapInArrow(learn, schema)
    summed = coded.repartition(F.coalesce(F.col("part").cast("long"), F.col("key"))).mapInArrow(add, schema)
    # One task, whose rows Spark sorts (and spills): it holds no more of them than the fit takes.
    in_order = summed.repartition(1).sortWithinPartitions("part", "key", "label", F.size("ids"), F.xxhash64("ids"))
    found = in_order.mapInArrow(train, "model binary").first()
    return zlib.decompress(found[0]) if found else pickle.dumps(0.5)


def counted(count: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of the features' counts in the two classes by range, and of the classes' sizes (part -1)."""
    return count_rows({k: count[:, k * RANGE : (k + 1) * RANGE].ravel() for k in range(DIM // RANGE)} | {-1: n})


def count_rows(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    data = [zlib.compress(np.ascontiguousarray(x, dtype=np.int64).tobytes(), 1) for x in sums.values()]
    none = [pa.nulls(len(data), t) for t in (pa.int64(), pa.int32(), pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), *none, pa.array(data, pa.binary())],
        ["part", "key", "label", "ids", "counts"],
    )


def fitted(y: np.ndarray, lists: list[np.ndarray], count: np.ndarray, n: np.ndarray) -> Model:
    """The model of a sample (y, lists) and the counts of features and rows in class 0 and 1 among all rows."""
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    ids = np.concatenate(lists).astype(np.int64)
    owner = np.repeat(np.arange(len(y)), np.diff(ends))
    share = lambda count, n: np.log((count + SMOOTH) / (n + 2 * SMOOTH))
    scale = share(count[1], n[1]) - share(count[0], n[0])
    weights = descend(ends, ids, y, scale)
    top = np.bincount(owner, weights=(weights[:-1] * scale)[ids], minlength=len(y))
    norm = np.sqrt(np.bincount(owner, weights=scale[ids] ** 2, minlength=len(y)))
    return Model(scale, weights, *curve(top / (norm + 1e-9) + weights[-1], y))


def scored(docs: DataFrame, model: bytes) -> DataFrame:
    """docs' (doc_id, text) -> (doc_id, score). The model's size is fixed (``DIM`` weights): it goes out as a broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = pickle.loads(shared.value)
        for batch in slices(batches, text_bytes("text"), SLICE_BYTES):
            texts = batch.column(1).to_pylist()
            score = np.full(len(texts), m) if isinstance(m, float) else m.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, score double"
    )


def train_on(docs: DataFrame, labels: DataFrame) -> bytes:
    """Fit on documents with a quality label that are not held out."""
    return fit(docs.where(~held_out("doc_id")), labels.where(~held_out("doc_id")).select("doc_id", F.col("quality").alias("label")))


def op9_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, train_on(docs, labels)).select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, model: bytes, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that score ``threshold`` or more, with their columns; scored where they are, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        m = pickle.loads(shared.value)
        for batch in slices(batches, text_bytes("text"), SLICE_BYTES):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            score = np.full(len(texts), m) if isinstance(m, float) else m.scores(texts)
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(run, docs.schema)
