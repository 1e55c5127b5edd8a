"""Contingency tables of two labelings, lookups, dense relabeling and run lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.store import row_numbers, stored


def segmentation_overlap(rows: DataFrame, a: str = "label_a", b: str = "label_b") -> DataFrame:
    """(label_a, label_b, count) of rows that carry both labels."""
    return rows.groupBy(F.col(a).alias("label_a"), F.col(b).alias("label_b")).agg(F.count(F.lit(1)).alias("count"))


def counts_table(table: DataFrame, side: str) -> DataFrame:
    """(label, count) of one side."""
    return table.groupBy(F.col(f"label_{side}").alias("label")).agg(F.sum("count").alias("count"))


def total_count(table: DataFrame) -> DataFrame:
    return table.agg(F.coalesce(F.sum("count"), F.lit(0).cast("long")).alias("total"))


def overlap_table(table: DataFrame, normalize_by: str | None = None) -> DataFrame:
    """The table with ``fraction``: of a label of side a or b, or of the total."""
    if normalize_by is None:
        return table
    if normalize_by == "total":
        whole = total_count(table)
        return table.crossJoin(F.broadcast(whole)).select("label_a", "label_b", "count", (F.col("count") / F.col("total")).alias("fraction"))
    side = counts_table(table, normalize_by).select(F.col("label").alias(f"label_{normalize_by}"), F.col("count").alias("all"))
    return table.join(side, f"label_{normalize_by}").select("label_a", "label_b", "count", (F.col("count") / F.col("all")).alias("fraction"))


def overlaps_for_label(table: DataFrame, label: int, side: str = "a", normalize: bool = False) -> DataFrame:
    """(label, count[, fraction]) of the other side's labels that share rows with one label."""
    other = "b" if side == "a" else "a"
    own = table.where(F.col(f"label_{side}") == label)
    if normalize:
        own = overlap_table(own, side)
    return own.select(F.col(f"label_{other}").alias("label"), "count", *(["fraction"] if normalize else []))


def best_overlap(table: DataFrame, side: str = "a", ignore_zero: bool = False) -> DataFrame:
    """(label, best, count, fraction, found) of every label of a side: most rows, the smaller label on ties. Without any
    (zero ignored): 0, 0, 0.0, false. Fractions are of all the label's rows."""
    other = F.col("label_b" if side == "a" else "label_a")
    counts = (other != 0) if ignore_zero else F.lit(True)
    best = F.max(F.when(counts, F.struct("count", (-other).alias("neg"))))
    found = table.groupBy(F.col(f"label_{side}").alias("label")).agg(best.alias("best"), F.sum("count").alias("all"))
    return found.select(
        "label", F.coalesce(-F.col("best.neg"), F.lit(0).cast("long")).alias("best"), F.coalesce("best.count", F.lit(0).cast("long")).alias("count"),
        F.coalesce(F.col("best.count") / F.col("all"), F.lit(0.0)).alias("fraction"), F.col("best").isNotNull().alias("found"),
    )


def overlapping_with_zero(table: DataFrame, side: str = "a") -> DataFrame:
    other = F.col("label_b" if side == "a" else "label_a")
    return table.groupBy(F.col(f"label_{side}").alias("label")).agg(F.max(other == 0).alias("with_zero"))


def different_overlap(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v, different): for labels u, v of side a, the chance that a row of each differ in b: 1 - sum p_u(b) p_v(b)."""
    p = overlap_table(table, "a").select("label_a", "label_b", "fraction")
    known = p.select("label_a").distinct()
    bad = F.raise_error(F.lit("unknown label")).cast("double")
    checked = (
        pairs.join(known.select(F.col("label_a").alias("u"), F.lit(1).alias("has_u")), "u", "left")
        .join(known.select(F.col("label_a").alias("v"), F.lit(1).alias("has_v")), "v", "left")
    )
    same = (
        pairs.join(p.select(F.col("label_a").alias("u"), "label_b", F.col("fraction").alias("pu")), "u")
        .join(p.select(F.col("label_a").alias("v"), "label_b", F.col("fraction").alias("pv")), ["v", "label_b"])
        .groupBy("u", "v").agg(F.sum(F.col("pu") * F.col("pv")).alias("same"))
    )
    out = checked.join(same, ["u", "v"], "left")
    good = F.col("has_u").isNotNull() & F.col("has_v").isNotNull()
    return out.select("u", "v", F.when(good, 1 - F.coalesce("same", F.lit(0.0))).otherwise(bad).alias("different"))


def take_dict(rows: DataFrame, mapping: DataFrame, column: str = "label") -> DataFrame:
    """rows with ``value`` from mapping (key, value); an error where a key is missing."""
    joined = rows.join(mapping, rows[column] == mapping["key"], "left")
    bad = F.raise_error(F.concat(F.lit("not a key: "), F.col(column).cast("string"))).cast(dict(mapping.dtypes)["value"])
    return joined.select(*rows.columns, F.when(F.col("key").isNull(), bad).otherwise(F.col("value")).alias("value"))


def relabel_sequential(rows: DataFrame, label: str = "label", offset: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows with ``relabeled``, the forward map (label, relabeled)): 0 stays 0, others get offset, offset + 1, ... in
    order. The inverse map is the forward one read backwards."""
    values = rows.where(F.col(label) != 0).select(label).distinct()
    forward = stored(row_numbers(values, [label], "relabeled", offset)).select(label, "relabeled")
    out = rows.join(forward, label, "left").withColumn("relabeled", F.coalesce("relabeled", F.lit(0).cast("long")))
    return out.select(*rows.columns, "relabeled"), forward


def run_lengths(rows: DataFrame, position: str = "node_id", mask: str = "mask", span: int = 1 << 20) -> DataFrame:
    """(run, length): lengths of the runs of a boolean column in order of position, beginning with a run of false (of
    length 0 if the first is true). Positions count up by one, as a grid's node ids do: lengths are their differences.

    Runs are found within spans of positions; only the runs at the spans' ends, two a span at most, are put together in
    one order.
    """
    block = F.expr(f"{position} div {span}")
    cut = rows.select(F.col(position).alias("pos"), F.col(mask).alias("on"), block.alias("_b"))
    order = Window.partitionBy("_b").orderBy("pos")
    starts = cut.withColumn("_new", F.coalesce((F.col("on") != F.lag("on").over(order)).cast("int"), F.lit(1)))
    numbered = starts.withColumn("_r", F.sum("_new").over(order))
    pieces = numbered.groupBy("_b", "_r").agg(F.min("pos").alias("pos"), F.first("on").alias("on"), F.count(F.lit(1)).alias("n"))
    # Pieces across span borders: a running number of changes over the pieces, numbered by range.
    pieces = row_numbers(pieces.select("pos", "on", "n"), ["pos"], "k")
    after = pieces.select((F.col("k") + 1).alias("k"), F.col("on").alias("before"))
    marked = pieces.join(after, "k", "left").withColumn("begins", F.col("before").isNull() | (F.col("before") != F.col("on")))
    heads = row_numbers(marked.where("begins").select(F.col("k").alias("head"), "on"), ["head"], "run")
    ends = heads.select((F.col("run") - 1).alias("run"), F.col("head").alias("stop"))
    bounds = heads.join(ends, "run", "left")
    # A run is its head piece and at most those that continue it: equal values in a row, so a sum between two heads.
    prefix = pieces.select("k", "pos")
    total = rows.agg((F.max(position) + 1).alias("end"))
    spans = (
        bounds.join(prefix.select(F.col("k").alias("head"), F.col("pos").alias("from")), "head")
        .join(prefix.select(F.col("k").alias("stop"), F.col("pos").alias("to")), "stop", "left")
        .crossJoin(F.broadcast(total))
    )
    found = spans.select("run", "on", (F.coalesce("to", "end") - F.col("from")).alias("length"))
    first = found.where("run = 0").select("on")
    shift = first.select(F.col("on").cast("long").alias("shift"))
    runs = found.crossJoin(F.broadcast(shift)).select((F.col("run") + F.col("shift")).alias("run"), "length")
    zero = first.where("on").select(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("length"))
    return runs.unionByName(zero)
