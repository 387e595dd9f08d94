"""Running statistics over files that arrive in turn."""

from allelix.operators.windows import Bins
from allelix.streaming import arrivals


def test_density_follows_the_files(spark, tmp_path):
    schema = "variant_id string, start_site long"
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    bins = Bins(0, 10, 2)
    seen = []
    for part in ([("a", 1), ("b", 9)], [("c", 2), ("d", None)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = arrivals.arriving(spark, folder, spark.createDataFrame([], schema).schema)
        arrivals.keep_table(arrivals.running_density(stream, bins), out, state).awaitTermination()
        seen.append({r.bin_start: r.variants for r in spark.read.parquet(out).collect()})
    assert seen == [{0: 1, 5: 1}, {0: 2, 5: 1}]


def test_call_rate(spark, tmp_path):
    schema = "variant_id string, gt string"
    spark.createDataFrame([("a", "0/1"), ("a", None)], schema).write.parquet(str(tmp_path / "in"))
    stream = arrivals.arriving(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
    arrivals.keep_table(arrivals.running_call_rate(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a", 1, 2)]
