"""Streams from files, and the command line."""

import json
from datetime import datetime, timedelta

import pytest
import yaml
from pyspark.sql import functions as F

from skyverify.plans import cli
from skyverify.streaming import observation_means, pair_stream

T0 = datetime(2024, 1, 1)


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps({"ts": (T0 + timedelta(hours=h)).isoformat(), "user": u, "v": v}) for h, u, v in rows))


def run(df, folder, mode):
    query = df.writeStream.format("parquet" if mode == "append" else "memory").outputMode(mode).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True)
    query = query.option("path", str(folder / "out")).start() if mode == "append" else query.queryName("means").start()
    query.awaitTermination(120)


def test_means_of_a_stream_drop_late_records(spark, tmp_path):
    schema, source = "ts timestamp, user int, v double", tmp_path / "in"
    means = lambda: observation_means(spark.readStream.schema(schema).json(str(source)), "ts", ["user"], "v", "6h", "1 hour")
    write(source, "a.json", [(0, 1, 1.0), (5, 1, 3.0), (1, 2, 9.0)])
    run(means(), tmp_path, "append")
    write(source, "b.json", [(14, 1, 7.0), (19, 1, 8.0)])
    run(means(), tmp_path, "append")
    write(source, "c.json", [(2, 1, 100.0), (30, 2, 1.0)])  # two hours are long gone
    run(means(), tmp_path, "append")
    write(source, "d.json", [(60, 2, 1.0)])
    run(means(), tmp_path, "append")
    run(means(), tmp_path, "append")
    got = {(r.valid_time, r.user): (r.value, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(T0, 1): (2.0, 2), (T0, 2): (9.0, 1), (T0 + timedelta(hours=12), 1): (7.0, 1), (T0 + timedelta(hours=18), 1): (8.0, 1), (T0 + timedelta(hours=30), 2): (1.0, 1)}


def test_a_stream_meets_a_forecast(spark, tmp_path):
    source = tmp_path / "in"
    write(source, "a.json", [(6, 1, 1.0), (12, 1, 2.0), (13, 1, 5.0)])
    forecast = spark.createDataFrame([(T0, 6, 1, 1.5), (T0, 12, 1, 2.5), (T0 + timedelta(hours=6), 6, 1, 2.25)], "reference_time timestamp_ntz, lead_s int, user int, fc double")
    forecast = forecast.withColumn("valid_time", F.expr("reference_time + make_dt_interval(0, lead_s)"))
    stream = spark.readStream.schema("ts timestamp, user int, v double").json(str(source)).withColumn("valid_time", F.col("ts").cast("timestamp_ntz"))
    run(pair_stream(stream, forecast, ["user"]).select("reference_time", "lead_s", "v", "fc"), tmp_path, "append")
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(T0, 6, 1.0, 1.5), (T0, 12, 2.0, 2.5), (T0 + timedelta(hours=6), 6, 2.0, 2.25)}


def test_command_line(spark, tmp_path, capsys):
    rows = [(T0 + timedelta(days=r), 21600 * s, p, float(r + s + p)) for r in range(3) for s in range(2) for p in range(2)]
    fc = spark.createDataFrame(rows, "reference_time timestamp_ntz, lead_s bigint, point_index bigint, t double").withColumns({"longitude": F.lit(1.0), "latitude": F.lit(2.0)})
    fc.write.parquet(str(tmp_path / "fc"))
    fc.withColumn("t", F.col("t") + 2).write.parquet(str(tmp_path / "ref"))
    config = {
        "datasets": {"fc": {"loader": "cube", "files": str(tmp_path / "fc")}, "ref": {"loader": "cube", "files": str(tmp_path / "ref")}},
        "transformations": [{"kelvin_to_celcius": {"variables": "t", "datasets": ["fc"]}}, {"kelvin_to_celcius": {"variables": "t", "datasets": ["ref"]}}],
        "verification": {"reference": "ref", "metrics": {"bias": {"function": "bias", "inputs": {"a": "forecast", "b": "reference"}}}, "save": {"method": "to_csv", "path": str(tmp_path / "metrics")}},
    }
    (tmp_path / "run.yaml").write_text(yaml.safe_dump(config))
    assert cli.main(["local", "--workers", "2", str(tmp_path / "run.yaml")]) == 0
    assert "bias" in capsys.readouterr().out
    assert [r.t for r in spark.read.csv(str(tmp_path / "metrics"), header=True, inferSchema=True).collect()] == [-2.0]
    (tmp_path / "bad.yaml").write_text("datasets: {}")
    assert cli.main(["local", str(tmp_path / "bad.yaml")]) == 1
    with pytest.raises(SystemExit):
        cli.main(["elsewhere", "x"])
