from __future__ import annotations

from tessera.streaming.churn import watch, windowed


def test_a_stream_gives_what_a_table_gives(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    query = watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert query.exception() is None
    of = lambda df: {(r.start, r.event_type): (r.n, round(r.total, 6)) for r in df.collect()}
    got, want = of(spark.read.parquet(str(tmp_path / "out"))), of(windowed(events, "1 day"))
    last = max(s for s, _ in want)
    # windows that the watermark hasn't passed stay open
    assert got == {k: v for k, v in want.items() if k in got} and {k for k in want if k[0] < last} <= set(got)
    assert len(got) > 5
