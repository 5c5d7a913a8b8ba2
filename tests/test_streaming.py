from quillgrid.operators.aggregate import count_op, make_sum
from quillgrid.streaming.maintained import maintain, result


def test_maintained_equals_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", "event_id")
    src.repartition(4).write.parquet(f"{tmp_path}/in")
    ops = [count_op, make_sum("event_id", "ids")]
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    maintain(stream, ["event_type"], ops, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    got = sorted(map(tuple, result(spark, ["event_type"], ops, f"{tmp_path}/out").collect()))
    assert got == sorted(map(tuple, src.groupBy("event_type").agg(*[o.column() for o in ops]).collect()))
