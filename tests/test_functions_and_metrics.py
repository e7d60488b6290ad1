"""Partitioners and run metrics on golden inputs."""

import math

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import partitioning as p
from loomgraph.operators import metrics as m


def owners(df, c):
    return {r[0]: r[1] for r in df.groupBy(c.alias("w")).count().collect()}


def test_rehash_counts(spark):
    ids, v = spark.range(100_000, 200_001), F.col("id")
    moves = {3: [(10, 0.0507)], 2: [(10, 0.0861)], 5: [(10, 0.1063)], 6: [(10, 0.0741)]}
    got = owners(ids, p.rehash_last(v, p.by_hash(v, 10), moves))
    assert got == {0: 10001, 1: 10000, 2: 8333, 3: 10000, 4: 10000, 5: 10000, 6: 8571, 7: 10000, 8: 10000, 9: 10000, 10: 3096}


def test_naive_counts(spark):
    ids, v = spark.range(100_000, 200_001), F.col("id")
    eleven = p.naive(v, p.by_hash(v, 10), 10, 11)
    assert owners(ids, eleven) == {i: 9091 for i in range(11)}
    twelve = owners(ids, p.naive(v, eleven, 11, 12))
    assert twelve == {0: 9091, 2: 9091, 4: 9091, 6: 9091, 8: 9091, 1: 7575, 3: 7576, 7: 7576, 9: 7576, 5: 7577, 10: 8333, 11: 8333}


def test_hashes(spark):
    row = spark.sql("SELECT -5L AS a, 4294967296L AS b, 'hello' AS s, 'polygenelubricants' AS t").select(p.long_hash(F.col("a")), p.long_hash(F.col("b")), p.string_hash(F.col("s")), p.string_hash(F.col("t")), p.by_hash(F.col("a"), 3)).first()
    assert row[0] == 4 and row[1] == 1 and row[2] == 99162322 and row[3] == -2147483648 and row[4] == 1


SD = [(0, 10, 10), (100, 10, 12), (200, 12, 12), (300, 12, 10), (400, 10, 10)]


@pytest.fixture
def sd(spark):
    return spark.createDataFrame([("r", i, i, t, s, d) for i, (t, s, d) in enumerate(SD)], "run string, seq int, step int, time_ms long, supply int, demand int")


def test_elasticity_golden(sd):
    r = m.elasticity(sd).first()
    assert (r.unit, r.t) == (100.0, 4.0)
    assert [r.accuracy_u, r.accuracy_o, r.accuracy_un, r.accuracy_on, r.accuracy_om] == [0.025, 0.025, 0.0, 0.0, 0.0]
    assert (r.wrong_u, r.wrong_o) == (0.25, 0.25)
    assert math.isclose(r.instability_i, 2 / 3) and math.isclose(r.instability_i2, 2 / 3)
    e = m.elasticity(sd, exact=True).first()
    assert math.isclose(e.accuracy_un, 1 / 24) and math.isclose(e.accuracy_on, 0.05)


def test_elasticity_without_time(spark):
    same = spark.createDataFrame([("r", 0, 0, 5, 1, 1), ("r", 1, 0, 5, 1, 2)], "run string, seq int, step int, time_ms long, supply int, demand int")
    assert m.elasticity(same).first().accuracy_u is None


def test_steps(sd):
    assert m.supply_steps(sd).count() == 9 and m.demand_steps(sd).count() == 9


def test_tournament_against_pairs(spark):
    rows = [("a", 1, 5), ("b", 1, 4), ("c", 3, 4), ("d", 2, 9)]
    got = {r.policy: r.score for r in m.tournament(spark.createDataFrame(rows, "policy string, low int, high int"), "policy", ["low"], ["high"]).collect()}
    win = lambda a, b: 1.0 if a < b else 0.5 if a == b else 0.0
    assert got == {n: sum(win(x, y) + win(q, h) for _, y, q in rows) for n, x, h in rows}


def test_tournament_with_nulls(spark):
    """A measure that is null neither wins nor draws, against nulls either."""
    rows = [("a", 1, 5), ("b", None, 4), ("c", None, None), ("d", 2, None), ("e", 1, 9)]
    got = {r.policy: r.score for r in m.tournament(spark.createDataFrame(rows, "policy string, low int, high int"), "policy", ["low"], ["high"]).collect()}
    win = lambda a, b: 0.0 if a is None or b is None else 1.0 if a < b else 0.5 if a == b else 0.0
    assert got == {n: sum(win(x, y) + win(q, h) for _, y, q in rows) for n, x, h in rows}


def test_whole_performance_tournament(spark):
    """Of two policies that tie in four measures, the other three decide."""
    names = ["policy", *m.PERFORMANCE, "vps", "eps"]
    rows = [("a", 5, 5, 1, 1, 1, 9, 9), ("b", 5, 5, 2, 2, 2, 9, 9)]
    got = {r.policy: r.score for r in m.performance_tournament(spark.createDataFrame(rows, names), "policy").collect()}
    assert got == {"a": 7 * 0.5 + 4 * 0.5 + 3, "b": 7 * 0.5 + 4 * 0.5}
    even = [(p, *[v] * len(m.ELASTICITY)) for p, v in (("a", 2.0), ("b", 1.0))]
    elastic = m.elastic_tournament(spark.createDataFrame(even, ["policy", *m.ELASTICITY]), "policy")
    assert {r.policy: r.score for r in elastic.collect()} == {"a": 9 * 0.5, "b": 9 * 1.5}


def test_combined_scores_with_nulls(spark):
    """Elasticity that is null adds nothing to a policy's performance."""
    performance = spark.createDataFrame([(p, *[v] * len(m.PERFORMANCE), 9, 9) for p, v in (("a", 1), ("b", 2))], ["policy", *m.PERFORMANCE, "vps", "eps"])
    kinds = "policy string, " + ", ".join(f"{c} double" for c in m.ELASTICITY)
    elastic = spark.createDataFrame([(p, *[0.0 if c == "accuracy_om" else None for c in m.ELASTICITY]) for p in "ab"], kinds)
    both = m.combined_scores(m.performance_tournament(performance, "policy"), m.elastic_tournament(elastic, "policy"), "policy")
    assert {r.policy: r.score for r in both.collect()} == {"a": 5 * 1.5 + 2 * 1.0 + 1.0, "b": 5 * 0.5 + 2 * 1.0 + 1.0}


def test_elastic_means_round_as_sql(spark):
    """A mean that ends in a half is rounded as the SQL does it, so that policies tie in both or in neither."""
    import duckdb

    runs = [("a", 0.760962448), ("a", 0.760962449), ("b", 0.760962449), ("b", 0.760962449)]
    each = spark.createDataFrame([(p, *[v] * len(m.ELASTICITY)) for p, v in runs], ["policy", *m.ELASTICITY])
    means = m.elastic_means(each, "policy")
    expected = {p: duckdb.execute("SELECT round(?, 9)", [sum(v for q, v in runs if q == p) / 2]).fetchone()[0] for p in "ab"}
    assert as_pairs(means.select("policy", "wrong_u")) == expected
    assert as_pairs(m.elastic_tournament(means, "policy")) == {"a": 9 * 1.0, "b": 9 * 1.0}


def as_pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def test_run_times(spark, sd):
    states = [("r", 0, 0, "RUN_SUPERSTEP", 0, 3000), ("r", 0, 1, "RUN_SUPERSTEP", 1000, 3500), ("r", 1, 0, "DISTRIBUTE_DATA", 4000, 16000), ("r", 3, 1, "DISTRIBUTE_DATA", 4000, 9000), ("r", 4, 1, "BARRIER", 20000, None)]
    got = m.run_times(spark.createDataFrame(states, "run string, step int, worker int, op string, start_ms long, stop_ms long"), sd).first()
    # Step 1 grows from 10 to 12 and step 3 shrinks; worker 0 works from 0 to 16 s, worker 1 from 1 to 20 s.
    assert (got.elastic_overhead_s, got.superstep_s, got.machine_s) == ((12000 // 10 * 12 + 5000) // 1000, 5, 35)
