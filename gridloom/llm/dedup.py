"""Near-duplicate detection by MinHash signatures and a multi-index Hamming join.

1. A document's set: its distinct word shingles. Documents with equal sets are one node, known by a fingerprint.
2. Each node has ``HASHES`` minimum hashes of 16 bits. Nodes of similarity 0.8 differ in a fifth of these on average; they
   differ in more than ``RADIUS`` with a probability below 1 in 10,000. The signature is split into ``CHUNKS`` chunks;
   by pigeonhole, two signatures within RADIUS have a chunk with at most RADIUS // CHUNKS errors; enumerating these
   errors (each choice of positions left out is a key) guarantees that all such pairs share a bucket.
3. In each bucket every node is paired with the least node, if their signatures are within RADIUS; pairs are confirmed
   on full sets. The links give first components. A bucket that is then within one component holds no other news.
4. The other buckets are gathered by their largest component, each node once for it. Nodes outside the component meet
   all that are gathered there, in cells of bounded size, by signature and then by full sets; only links leave a cell.
   Buckets of unlinked nodes that meet in this way already are passed over. So every pair in a bucket is either in one
   component or compared, and no pairs within a group are emitted.
5. Components of all links, by stars of each task's links and then alternating large and small stars; a component's id is
   its smallest doc_id.

No step brings documents, links or components to the driver. Sets are needed only for nodes in buckets with others; a
bit map of fixed size (``MAP_BITS``) picks these out while the texts are read again. Sets are lists of 48-bit hashes.

Defined cases: null and empty text, or text without words, has an empty set, component doc_id, and is kept; a text with
fewer words than a shingle has one shingle; rows with equal doc_id but other texts are documents of their own; identical
rows are in one component; with null doc_id the component's smallest other doc_id stands, or null if there is none; an
empty table gives an empty table; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gridloom.llm.common import own_cache, saved, slices, text_bytes, text_of
from gridloom.operators.graphs import roots

SLICE_BYTES = 1_500_000
CACHE_MAX = 300_000
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = str.maketrans("\t\n\x0b\x0c\r", "     ")
#: Minimum hashes of a signature, bits kept of each, signature distance (positions that differ) to guarantee, chunks.
HASHES, WIDTH, RADIUS, CHUNKS = 96, np.uint16, 35, 18
ERRORS = RADIUS // CHUNKS
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: Bits of the map of nodes whose sets are needed.
MAP_BITS = 1 << 26
#: Rows of a cell on either side.
OTHERS, ALL = 128, 256
PERCENT = 80


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ends, hashes): the distinct shingles of each text, sorted: hashes[ends[k]:ends[k + 1]].

    Words are runs of anything but ASCII white space, with A-Z lower-cased; a shingle is ``width`` words in a row, or all
    words of a text that has fewer; each is known by a 64-bit hash.
    """
    import xxhash

    cut = [t.translate(SPACES).translate(LOWER).split(" ") if not t.isascii() else t.translate(SPACES).lower().split(" ") for t in texts]
    words = set(chain.from_iterable(cut))
    words.discard("")
    known = own_cache("dedup", CACHE_MAX)
    known = own_cache("dedup", CACHE_MAX, len(words.difference(known)))
    code = xxhash.xxh64_intdigest
    for w in words.difference(known):
        known[w] = code(w) | 1
    known[""] = 0
    flat = np.fromiter(map(known.__getitem__, chain.from_iterable(cut)), dtype=np.uint64, count=sum(map(len, cut)))
    owner = np.repeat(np.arange(len(cut)), np.fromiter(map(len, cut), dtype=np.int64, count=len(cut)))
    real = flat != 0
    flat, owner = flat[real], owner[real]
    n = np.bincount(owner, minlength=len(cut))
    first = np.cumsum(n) - n
    # A text's shingles start at its first words; a text of fewer words has one, of all its words.
    have = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    own = np.repeat(np.arange(len(cut)), have)
    at = np.arange(len(own)) - np.repeat(np.cumsum(have) - have, have) + first[own]
    value = np.full(len(own), np.uint64(0x165667B19E3779F9))
    stop = (first + n)[own]
    for k in range(width):
        there = at + k < stop
        word = flat[np.minimum(at + k, max(len(flat) - 1, 0))] if len(flat) else value
        value = np.where(there, mixed(value * M1 + word), value)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[keep], own[keep]
    return np.searchsorted(own, np.arange(len(cut) + 1)), value


def signatures(ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """b-bit minimum hashes, a row for each set (all 0 for an empty one)."""
    out = np.zeros((len(ends) - 1, HASHES), dtype=WIDTH)
    some = np.flatnonzero(ends[1:] > ends[:-1])
    if not len(some):
        return out
    rng = np.random.default_rng(1)
    a = (rng.integers(1, 2**32, HASHES, dtype=np.uint64) | 1).astype(np.uint32)
    b = rng.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)
    starts = ends[some]
    high, low = (hashes >> np.uint64(32)).astype(np.uint32), hashes.astype(np.uint32)
    for j in range(HASHES):
        # A permutation of 32-bit numbers for each j; the low word, added in, keeps equal high words apart.
        h = high * a[j] + (low ^ b[j])
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        least = np.minimum.reduceat(h, starts)
        out[some, j] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(WIDTH)
    return out


def chunk_keys(sig: np.ndarray) -> np.ndarray:
    """Every chunk with each choice of ERRORS positions left out, as 64-bit keys: rows x keys.

    Two signatures that differ in RADIUS positions at most have, by pigeonhole, a chunk that differs in
    RADIUS // CHUNKS = ERRORS positions at most, and agree in the key that leaves these out.
    """
    from itertools import combinations

    bounds = np.linspace(0, HASHES, CHUNKS + 1).round().astype(int)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        for left_out in combinations(range(lo, hi), ERRORS):
            key = np.full(len(sig), (len(out) + 1) * int(M2) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
            for j in range(lo, hi):
                if j not in left_out:
                    key = mixed(key * M1 + sig[:, j].astype(np.uint64) + np.uint64(j))
            out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def set_nodes(ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes * M1), dtype=np.uint64)])
    xors = np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(mixed(hashes + M2))])
    a, b = sums[ends[1:]] - sums[ends[:-1]], xors[ends[1:]] ^ xors[ends[:-1]]
    return mixed(mixed(a) * M1 + b).view(np.int64)


def packed(hashes: np.ndarray) -> bytes:
    """48 bits of each hash, sorted."""
    cut = np.sort(hashes >> np.uint64(16))
    return cut.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def is_link(shared, a, b, percent: int = PERCENT):
    """100 * intersection >= percent * union."""
    return 100 * shared >= percent * (a + b - shared)


def with_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, node, n, sig) of every row; node is null for an empty set."""

    def run(batches):
        for batch in slices(batches, text_bytes("text"), SLICE_BYTES):
            ends, hashes = shingle_sets(batch.column(1).to_pylist(), width)
            n = np.diff(ends)
            sig = signatures(ends, hashes)
            node = pa.array(set_nodes(ends, hashes), mask=n == 0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), node, pa.array(n), pa.array([r.tobytes() for r in sig], pa.binary())], ["doc_id", "node", "n", "sig"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, node long, n long, sig binary")


def keyed(nodes: DataFrame) -> DataFrame:
    """(key, node) for every chunk key of every node."""

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                batch = whole.slice(k, 2000)
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=WIDTH).reshape(-1, HASHES)
                keys = chunk_keys(sig)
                node = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], ["key", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, node long")


def near(pairs: DataFrame) -> DataFrame:
    """The pairs (node, hub, sig, hub_sig) within RADIUS."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=WIDTH).reshape(-1, HASHES) for k in (2, 3))
            good = (a != b).sum(axis=1) <= RADIUS
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["node", "hub"]).filter(pa.array(good))

    return pairs.select("node", "hub", "sig", "hub_sig").mapInArrow(run, "node long, hub long")


def map_bit():
    return F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS))


def wanted_map(ids: DataFrame) -> bytes:
    """A bit map of MAP_BITS bits with the doc_ids of ids set: of fixed size, however many there are."""
    bit = map_bit()
    words = (
        ids.select(F.expr("1L").alias("one"), (bit % 32).cast("int").alias("at"), F.shiftright(bit, 5).alias("word"))
        .groupBy("word")
        .agg(F.bit_or(F.expr("shiftleft(one, at)")).alias("bits"))
        .toPandas()  # MAP_BITS / 32 rows at most
    )
    out = np.zeros(MAP_BITS // 32, dtype=np.uint32)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out.tobytes()


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(node, set) for the texts of ids' doc_ids, and perhaps of some others."""
    shared = docs.sparkSession.sparkContext.broadcast(zlib.compress(wanted_map(ids), 1))

    def run(batches):
        bits = np.frombuffer(zlib.decompress(shared.value), dtype=np.uint32)
        seen: set[int] = set()
        for batch in slices(batches, text_bytes("text"), SLICE_BYTES):
            bit = batch.column(1).to_numpy()
            some = np.flatnonzero(bits[bit >> 5] >> (bit & 31).astype(np.uint32) & np.uint32(1))
            if not len(some):
                continue
            ends, hashes = shingle_sets(batch.column(0).take(pa.array(some)).to_pylist(), width)
            nodes = set_nodes(ends, hashes)
            # Copies of a text in one task give one row (copies elsewhere do no harm).
            seen = seen if len(seen) < 1_000_000 else set()
            fresh = [k for k, x in enumerate(nodes.tolist()) if ends[k + 1] > ends[k] and not (x in seen or seen.add(x))]
            sets = [packed(hashes[ends[k] : ends[k + 1]]) for k in fresh]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[fresh]), pa.array(sets, pa.binary())], ["node", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.select("text", map_bit().alias("bit")).mapInArrow(run, "node long, set binary")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, hub) that are links."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = unpacked(x), unpacked(y)
                if percent * max(len(a), len(b)) > 100 * min(len(a), len(b)):
                    good.append(False)
                    continue
                small, large = (a, b) if len(a) < len(b) else (b, a)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                good.append(bool(is_link(int((large[at] == small).sum()), len(a), len(b), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["node", "hub"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets, "node").join(sets.select(F.col("node").alias("hub"), F.col("set").alias("hub_set")), "hub")
    return both.select("node", "hub", "set", "hub_set").mapInArrow(run, "node long, hub long")


def components(edges: DataFrame, a: str = "node", b: str = "hub") -> DataFrame:
    """(node, comp) of every node with an edge; comp is the least node that it reaches."""
    return roots(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))).select("node", F.col("root").alias("comp"))


def cells(members: DataFrame) -> DataFrame:
    """(main, node, comp) -> (main, o, a, other, node, comp): the cells in which nodes outside ``main`` meet all."""
    other = F.col("comp") != F.col("main")
    size = members.groupBy(F.col("main").alias("m")).agg(
        F.ceil(F.sum(other.cast("int")) / OTHERS).cast("int").alias("n_o"), F.ceil(F.count(F.lit(1)) / ALL).cast("int").alias("n_a")
    )
    # The sizes are written, so that their join can be split, and the rows are dealt anew by node before they multiply.
    sized = members.join(saved(size, "dedup-cells"), F.col("main") == F.col("m"))
    sized = saved(sized.select("main", "node", "comp", "n_o", "n_a"), "dedup-sized").repartition("node", "main")
    left = sized.where(other).select(
        "main", F.pmod(F.xxhash64(F.lit(3), "node"), "n_o").cast("int").alias("o"),
        F.explode(F.sequence(F.lit(0), F.col("n_a") - 1)).alias("a"), F.lit(True).alias("other"), "node", "comp",
    )
    right = sized.select(
        "main", F.explode(F.sequence(F.lit(0), F.col("n_o") - 1)).alias("o"),
        F.pmod(F.xxhash64(F.lit(5), "node"), "n_a").cast("int").alias("a"), F.lit(False).alias("other"), "node", "comp",
    )
    return left.unionByName(right)


def links_in_cells(rows: DataFrame, percent: int) -> DataFrame:
    """The links (node, hub) between components in each cell of (main, o, a, other, node, comp, sig, set)."""

    def compare(own: list) -> list[tuple[int, int]]:
        out = []
        left, right = [r for r in own if r[3]], [r for r in own if not r[3]]
        if not left or not right:
            return out
        sig = np.frombuffer(b"".join(r[6] for r in right), dtype=WIDTH).reshape(-1, HASHES)
        comp = np.array([r[5] for r in right])
        length = np.array([len(r[7]) // 6 for r in right])
        sets: dict[int, np.ndarray] = {}
        for r in left:
            near_ = np.flatnonzero((comp != r[5]) & ((sig != np.frombuffer(r[6], dtype=WIDTH)).sum(axis=1) <= RADIUS))
            n = len(r[7]) // 6
            near_ = near_[percent * np.maximum(length[near_], n) <= 100 * np.minimum(length[near_], n)]
            if not len(near_):
                continue
            x = unpacked(r[7])
            for k in near_.tolist():
                if k not in sets:
                    sets[k] = unpacked(right[k][7])
            flat = np.concatenate([sets[k] for k in near_.tolist()])
            hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
            shared = np.add.reduceat(hit, np.cumsum(length[near_]) - length[near_], dtype=np.int64)
            for k in near_[is_link(shared, length[near_], n, percent)].tolist():
                out.append((r[4], right[k][4]))
        return out

    def run(batches):
        at, own, found = None, [], []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                if row[:3] != at:
                    found += compare(own)
                    at, own = row[:3], []
                own.append(row)
            if found:
                yield pa.RecordBatch.from_pydict({"node": [x[0] for x in found], "hub": [x[1] for x in found]})
                found = []
        found = compare(own)
        if found:
            yield pa.RecordBatch.from_pydict({"node": [x[0] for x in found], "hub": [x[1] for x in found]})

    cell = ["main", "o", "a"]
    return (
        rows.select(*cell, "other", "node", "comp", "sig", "set")
        .repartition(*cell)
        .sortWithinPartitions(*cell)
        .mapInArrow(run, "node long, hub long")
    )


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """(doc_id, node, n, component_id) of every row of docs (doc_id, text): n is its set's size, node stands for the set."""
    return grouped(docs, width, percent).drop("comp")


def grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of near_duplicates and comp, the node that stands for their group, which doc_ids that are shared do not."""
    rows = saved(with_sets(docs, width), "dedup-rows")
    nodes = saved(
        rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("sig").alias("sig")),
        "dedup-nodes",
    )
    buckets = keyed(nodes).groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # Spark takes keys and cells for as few as the rows they are made of: their joins are not chosen by size.
    stars = saved(keyed(nodes).join(buckets.hint("merge"), "key").where("node != hub"), "dedup-stars")
    sig = nodes.select("node", "sig")
    pairs = stars.select("node", "hub").distinct()
    pairs = pairs.join(sig, "node").join(sig.select(F.col("node").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
    pairs = saved(near(pairs), "dedup-pairs")
    wide = stars.where("size > 2")
    ids = (
        pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node")))
        .unionByName(wide.select("node")).unionByName(wide.select(F.col("hub").alias("node"))).distinct()
    )
    sets = saved(sets_of(docs, nodes.join(ids, "node", "left_semi").select("doc_id"), width), "dedup-sets")
    links = saved(confirmed(pairs, sets, percent), "dedup-links")
    first = components(links)

    size = saved(first.groupBy("comp").agg(F.count(F.lit(1)).alias("comp_size")), "dedup-sizes")
    first = saved(first.join(size, "comp").select("node", "comp", "comp_size"), "dedup-first")
    inside = wide.select("key", "node").unionByName(wide.select("key", F.col("hub").alias("node")).distinct())
    inside = inside.join(first, "node", "left").select(
        "key", "node", F.coalesce("comp", "node").alias("comp"), F.coalesce("comp_size", F.lit(1)).alias("comp_size")
    )
    split = (
        inside.groupBy("key").agg(F.max(F.struct("comp_size", "comp")).alias("main"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        .where("low != high").select("key", F.col("main.comp").alias("main"), F.col("main.comp_size").alias("main_size"))
    )
    open_ = saved(inside.join(saved(split, "dedup-split"), "key").select("key", "main", "main_size", "node", "comp"), "dedup-open")
    grouped = open_.where("main_size > 1")
    # Nodes that are gathered for one component meet there: a bucket of such nodes alone holds no other pairs.
    home = grouped.groupBy("node").agg(F.max(F.struct("main_size", "main"))["main"].alias("home"))
    alone = open_.where("main_size = 1").join(home, "node", "left")
    left = alone.groupBy("key").agg(
        F.min("home").alias("low"), F.max("home").alias("high"), F.count("home").alias("homes"), F.count(F.lit(1)).alias("rows")
    )
    left = left.where("homes < rows OR low != high").select("key")
    members = grouped.unionByName(open_.where("main_size = 1").join(left, "key", "left_semi"))
    members = saved(members.select("main", "node", "comp").distinct(), "dedup-members")
    # One table with all that a cell needs of a node, so that its rows are joined once.
    known = saved(sets.join(sig, "node"), "dedup-known")
    met = cells(members).join(known.hint("merge"), "node")
    links = links.unionByName(links_in_cells(met, percent))
    comps = components(links)

    named = nodes.select("node", "doc_id").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = saved(named, "dedup-named")
    # Written first: then both sides of the join come from plain exchanges, whose hot keys can be split.
    least = saved(named.groupBy("comp").agg(F.min("doc_id").alias("component_id")), "dedup-least")
    of_node = named.join(least, "comp").select(F.col("node").alias("set_node"), "component_id", "comp")
    out = rows.select("doc_id", "node", "n").join(of_node, F.col("node") == F.col("set_node"), "left")
    head = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    return out.select("doc_id", "node", "n", head, "comp")


def keep_one(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near duplicates, with their columns: that of its smallest doc_id. Rows without a
    word are no group; of those with equal doc_id and text one stays where doc_ids are shared."""
    found = saved(grouped(docs, width, percent), "dedup-found")
    first = found.where("node IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("head"))
    keep = first.select(F.col("head.doc_id").alias("__dedup_id"), F.col("head.node").alias("__dedup_node"))
    if not found.groupBy("doc_id").count().where("count > 1").limit(1).count():
        keep = keep.select("__dedup_id").unionByName(found.where("node IS NULL").select(F.col("doc_id").alias("__dedup_id")))
        return docs.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("__dedup_id")), "left_semi")
    keep = keep.unionByName(found.where("node IS NULL").select(F.col("doc_id").alias("__dedup_id"), F.col("node").alias("__dedup_node")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__dedup_id")) & F.col("__node").eqNullSafe(F.col("__dedup_node"))
    out = with_nodes(docs, width).join(keep, same, "left_semi").withColumn("__empty", F.when(F.col("__node").isNull(), text_of()))
    return out.dropDuplicates(["doc_id", "__node", "__empty"]).select(*docs.columns)


def with_nodes(docs: DataFrame, width: int) -> DataFrame:
    """docs and the node of each row's set in a column __node."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches, text_bytes("text"), SLICE_BYTES):
            ends, hashes = shingle_sets([t or "" for t in batch.column(at).to_pylist()], width)
            node = pa.array(set_nodes(ends, hashes), mask=np.diff(ends) == 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, node], [*batch.schema.names, "__node"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("__node", LongType())]))


def op1_near_duplicates(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs, width=2).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


#: DuckDB's form: all pairs that share a shingle, then reachability.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh
  FROM w
), e AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c
  FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), l AS (
  SELECT x, y FROM p WHERE 100 * c >= 80 * (nx + ny - c)
), b AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(doc_id, reach) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, b.y FROM r JOIN b ON r.reach = b.x
)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id) m ON s.doc_id = m.doc_id
"""
