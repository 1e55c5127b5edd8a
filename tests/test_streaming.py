import uuid

from pyspark.sql import functions as F

from gridloom.operators import rag
from gridloom.streaming import mergers


def files(spark, tmp_path, rows, schema, parts=3):
    for k in range(parts):
        spark.createDataFrame(rows[k::parts], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drained(stream, mode):
    name = f"q{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return name


def test_streamed_statistics_equal_the_batch(spark, tmp_path):
    rows = [(k % 3, 3 + k % 2, float(k * k % 17)) for k in range(90)]
    schema = "u long, v long, v_ double"
    got = spark.table(drained(mergers.edge_stats(files(spark, tmp_path, rows, schema)), "complete"))
    want = rag.moments(spark.createDataFrame(rows, schema), ["u", "v"])
    key = lambda df: sorted(tuple(round(float(x), 9) for x in r) for r in df.select("u", "v", "count", "mean", "m2", "min", "max").collect())
    assert key(got) == key(want)


def test_streamed_edges(spark, tmp_path):
    rows = [(k % 5, k % 3) for k in range(60)]
    got = spark.table(drained(mergers.edge_set(files(spark, tmp_path, rows, "u long, v long")), "append"))
    want = {(min(a, b), max(a, b)) for a, b in rows if a != b}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_entry_store(spark, tmp_path):
    schema = "entry_id long, entry array<struct<id:long,count:long>>"
    rows = [(k, [(k % 4, 2)]) for k in range(9)]
    store = mergers.EntryStore(spark, str(tmp_path / "store"))
    stream = files(spark, tmp_path, rows, schema)
    stream.writeStream.foreachBatch(store.update).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    last = store.version(2)
    assert last.count() == 4 and sorted(r[0] for r in last.select(F.col("entry_id")).collect()) == [0, 1, 2, 3]
