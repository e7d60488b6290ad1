"""Text input and output, result directories, and the stream of samples."""

import datetime

import pytest

from loomgraph import sources, streaming
from loomgraph.sources.results import container_times


def test_edges(spark, tmp_path):
    (tmp_path / "e").write_text("1 2 0.5\n3\t4 1\n")
    got = sorted(tuple(r) for r in sources.read_edges(spark, str(tmp_path / "e"), weighted=True).collect())
    assert got == [(1, 2, 0.5), (3, 4, 1.0)]
    assert sources.read_edges(spark, str(tmp_path / "e"), constant=True).columns == ["src", "dst", "e"]


def test_bad_line(spark, tmp_path):
    (tmp_path / "e").write_text("1 2\n3  4\n5 6\n")
    with pytest.raises(Exception, match="not a line"):
        sources.read_edges(spark, str(tmp_path / "e")).collect()
    assert sorted(tuple(r) for r in sources.read_edges(spark, str(tmp_path / "e"), permissive=True).collect()) == [(1, 2), (5, 6)]


def test_vertices_round_trip(spark, tmp_path):
    state = spark.createDataFrame([(1, 5), (2, None)], "id long, value long")
    sources.write_vertices(state, str(tmp_path / "out"))
    sources.write_vertices(state, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1 5", "2 "]
    (tmp_path / "v").write_text("7\n8\n")
    assert sorted(r.id for r in sources.read_vertices(spark, str(tmp_path / "v")).collect()) == [7, 8]


def test_metrics_round_trip(spark, tmp_path):
    table = spark.createDataFrame([("r", 0, 1)], "run string, step int, n long")
    sources.write_metrics({"active_vertices": table}, str(tmp_path / "m"))
    assert sources.read_metrics(spark, str(tmp_path / "m"), ("active_vertices",))["active_vertices"].count() == 1


def _result(at, valid=True, directed="true", policy="a.b.CPUPolicyV2"):
    (at / "config/graphs").mkdir(parents=True)
    (at / "benchmark.properties").write_text(f"# a comment\nbenchmark.run.graphs = g\nbenchmark.run.algorithms: BFS\njob.policy.name={policy}\njob.max-worker-count=20\n")
    (at / "config/graphs/g.properties").write_text(f"graph.g.meta.vertices = 10\ngraph.g.meta.edges = 30\ngraph.g.directed = {directed}\n")
    (at / "benchmark.log").write_text(("Validation successful\n" if valid else "") + "ProcessingTime: 4200\nBFS took 9999 ms.\n")


def test_results(spark, tmp_path):
    _result(tmp_path / "a")
    _result(tmp_path / "b", directed="false", policy="x.Other")
    _result(tmp_path / "c", valid=False)
    got = sorted(tuple(r)[1:] for r in sources.read_results(spark, str(tmp_path)).collect())
    assert got == [("g", "BFS", "CPUv2", 20, 10, 30, 4, 9), ("g", "BFS", "UNKNOWN", 20, 10, 60, 4, 9)]


def test_container_logs(spark, tmp_path):
    (tmp_path / "app.stdout").write_text("noise\n[INFO] [09/27/2016 15:28:34.700] a\n[WARN] [SECURITY] [09/27/2016 15:28:35.000] b\n[ERROR] [09/27/2016 15:28:36.200] c\n")
    r = container_times(spark, str(tmp_path / "app.stdout")).first()
    assert r.last_ms - r.first_ms == 1500


def test_stream_of_samples(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [("r", 0, 1, at(1), "cpu", 1.0), ("r", 0, 1, at(2), "cpu", 3.0)]
    spark.createDataFrame(rows, streaming.SAMPLES).write.parquet(str(tmp_path / "in"))
    query = streaming.live_statistics(streaming.read_samples(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("live").start()
    try:
        query.processAllAvailable()
        r = spark.table("live").first()
        assert (r.average, r.n) == (2.0, 2) and abs(r["std"] - 2**0.5) < 1e-12
    finally:
        query.stop()
