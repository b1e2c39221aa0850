"""The streaming audit against the same checks over the whole table."""

import datetime as dt

from plumbline.operators.checks import file_hits
from plumbline.streaming import landing


def test_stream_finds_what_a_batch_finds(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [("p", "a.py", "y = yaml.load(f)", at(1)), ("p", "b.md", "clean", at(2)), ("q", "c.json", '{"constructor": 1}', at(3)), ("q", "d.py", "yaml.unsafe_load(x)", at(25)), ("q", "e.py", None, at(26))]
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, landing.SCHEMA).write.parquet(str(tmp_path / "in" / f"part{i}"))
    whole = spark.createDataFrame(rows, landing.SCHEMA)
    stream = landing.read_landing(spark, str(tmp_path / "in" / "*"), files_per_batch=1)
    landing.sink(landing.hits(stream), str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    cols = ["pkg_id", "check_id", "path", "detail"]
    got = spark.read.parquet(str(tmp_path / "out")).select(cols).collect()
    assert sorted(got) == sorted(file_hits(whole).select(cols).collect()) and len(got) == 3
    q = landing.counts(landing.hits(stream)).writeStream.format("memory").queryName("landed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.begins.minute, r.check_id, r.n) for r in spark.table("landed").collect()} == {(0, "AST04-yaml-injection", 1), (0, "AST04-json-injection", 1), (20, "AST04-yaml-injection", 1)}
