"""Streams over a finished folder give what a batch gives."""

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from support import rows
from pyspark.sql import functions as F

from corelode.functions.predicates import GRADE
from corelode.operators import scoring as I
from corelode.operators import validate as V
from corelode.streaming import jobs as J


def test_quality_history(spark, samples, tmp_path):
    source, history = str(tmp_path / "in"), str(tmp_path / "history")
    plain = samples.drop("sampled_at")
    plain.filter("Element <> 'Cu'").coalesce(1).write.parquet(source)
    plain.filter("Element = 'Cu'").coalesce(1).write.mode("append").parquet(source)
    stream = J.file_stream(spark, source, plain.schema, files_per_batch=1)
    J.stream_quality(stream, history, str(tmp_path / "cp"), once=True).awaitTermination()
    lines = J.read_history(spark, history)
    assert lines.count() == 2 and lines.agg(F.sum("rows")).first()[0] == plain.count()
    trend = V.quality_trend(lines).first()
    assert trend["total_checks"] == 2 and trend["pass_rate"] == 0 and trend["latest_status"] == "FAILED"


def test_requests_are_served_once_per_ttl(spark, tmp_path):
    start = pd.Timestamp("2024-01-01")
    events = [(i, "cu" if i % 3 == 0 else "au", start + pd.Timedelta(minutes=7 * i)) for i in range(60)]
    pdf = pd.DataFrame(events, columns=["event_id", "element", "ts"])
    df = spark.createDataFrame(pdf).withColumns({c: F.lit(1.0) for c in ("latitude", "longitude", "depth_from", "depth_to")})
    source = str(tmp_path / "in")
    for part in (df.filter("event_id < 25"), df.filter("event_id >= 25")):
        part.coalesce(1).write.mode("append").parquet(source)
    stream = J.file_stream(spark, source, df.schema, files_per_batch=1)
    J.request_dedup(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = {r["event_id"]: r["served"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    last, want = {}, {}
    for i, e, ts in events:
        want[i] = e not in last or (ts - last[e]).total_seconds() >= J.TIME_TO_LIVE
        if want[i]:
            last[e] = ts
    assert got == want
    share = J.served_share(spark.read.parquet(str(tmp_path / "out"))).first()
    assert share["served"] == sum(want.values()) and share["repeated"] == 60 - share["served"]


def test_scores_equal_the_batch(spark, samples, tmp_path):
    trained = I.train_for_points(samples, "cu", maxIter=2, maxDepth=2)
    points = spark.createDataFrame(
        [(-15.2, -71.85, 0.0, 5.0), (-15.19, -71.86, 1.0, 5.0), (99.0, 0.0, 0.0, 1.0), (-15.2, -71.85, 9.0, 5.0)],
        "latitude double, longitude double, depth_from double, depth_to double")
    source = str(tmp_path / "in")
    points.coalesce(1).write.parquet(source)
    stream = J.file_stream(spark, source, points.schema)
    J.stream_score(stream, trained, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    batch = I.score_points(points, trained, strict=False)
    assert rows(got, "latitude", "predicted_grade_ppm") == rows(batch.select("coordinates.latitude", "predicted_grade_ppm"))
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2
    assert got.count() == 4


def test_registry_follows_new_documents(spark, tmp_path):
    folder = tmp_path / "models"
    folder.mkdir()
    for stamp, element in (("20250101_000000", "CU"), ("20250105_000000", "CU"), ("20250103_000000", "AU")):
        (folder / f"model_metadata_{stamp}.json").write_text(json.dumps({"element": element, "model_path": stamp}, indent=1))
    J.stream_registry(spark, str(folder), str(tmp_path / "newest"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert rows(J.newest_registry(spark, str(tmp_path / "newest")), "element", "trained") == [("AU", "20250103_000000"), ("CU", "20250105_000000")]


def test_a_batch_makes_its_report_once(spark, samples, tmp_path, monkeypatch):
    kept, keep = [], J.keep
    monkeypatch.setattr(J, "keep", lambda df: kept.append(df.columns) or keep(df))
    source, history = str(tmp_path / "in"), str(tmp_path / "history")
    samples.limit(50).coalesce(1).write.parquet(source)
    J.stream_quality(J.file_stream(spark, source, samples.schema), history, str(tmp_path / "cp"), once=True).awaitTermination()
    assert len(kept) == 1 and J.read_history(spark, history).first()["rows"] == 50


def test_keys_share_a_state_and_keep_apart(spark, tmp_path):
    """A hundred keys in one bucket, over two batches, with rows that lack a key or a time, against a plain loop."""
    start = datetime(2024, 1, 1)
    batches = [[(b * 1000 + i, None if i % 101 == 7 else f"k{i % 100}", start + timedelta(minutes=200 * b + i // 10)) for i in range(800)] for b in range(2)]
    batches[0] += [(5000, "late", None), (5001, "late", start), (5002, "only", None), (5003, "only", None)]
    source = str(tmp_path / "in")
    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, "event_id long, request_key string, ts timestamp").coalesce(1).write.parquet(f"{source}/b={number}")
    stream = J.file_stream(spark, f"{source}/*", spark.read.parquet(f"{source}/b=0").schema, files_per_batch=1)
    query = J._run(J.serve_once(stream, buckets=1).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append"), str(tmp_path / "cp"), True)
    query.awaitTermination()
    assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]][-1:] == [1]
    last, want = {}, {}
    for e, key, ts in sorted((r for batch in batches for r in batch), key=lambda r: (r[2] is None, r[2], r[0])):
        want[e] = key not in last or (ts is not None and (ts - last[key]).total_seconds() >= J.TIME_TO_LIVE)
        if want[e]:
            last[key] = ts
    got = {r["event_id"]: r["served"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want
