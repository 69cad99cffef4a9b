"""Cells of a stream equal cells of all its rows."""

from hydrolake.operators import measurements as M
from hydrolake.streaming import cells
from tests.test_measurements import raw


def test_stream(spark, tmp_path):
    rows = [{"resultObservedValue": str(k), "phenomenonTimeSamplingDate": f"20150{k % 5 + 1}11"} for k in range(30)]
    for part in (rows[:10], rows[10:]):
        raw(spark, *part).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(raw(spark, {}).schema).parquet(f"{tmp_path}/in")
        cells.follow(stream, f"{tmp_path}/out", f"{tmp_path}/state", once=True).awaitTermination()
    key = lambda df: sorted(map(tuple, df.select(*M.KEY, "n", "sum_value", "min", "max").collect()))
    assert key(cells.read(spark, f"{tmp_path}/out")) == key(M.monthly_cells(M.kept(raw(spark, *rows))))
    cells.compact(spark, f"{tmp_path}/out", f"{tmp_path}/store")
    assert spark.read.parquet(f"{tmp_path}/store").count() == 5
