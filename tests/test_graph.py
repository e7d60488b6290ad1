"""Loading, golden graphs, and what a superstep does."""

import inspect
import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph import algorithms
from loomgraph.graph import Graph
from loomgraph.operators.engine import run
from loomgraph.operators.program import Aggregator, Along, Context, PandasStep, PregelStep, Send, UniformProgram, VertexProgram

M1 = [(1, 2, 1.0), (1, 3, 5.0), (2, 3, 1.5), (3, 1, 1.0), (4, 3, 0.5), (5, 6, 2.0)]


@pytest.fixture(scope="module")
def m1(spark):
    edges = spark.createDataFrame(M1, "src long, dst long, e double")
    return Graph.with_vertices(edges, spark.range(1, 8))


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_golden_algorithms(m1):
    far = algorithms.programs.UNREACHED
    assert as_dict(algorithms.bfs(m1, 1).values()) == {1: 0, 2: 1, 3: 1, 4: far, 5: far, 6: far, 7: far}
    found = as_dict(algorithms.sssp(m1, 1).values())
    assert [found[i] for i in (1, 2, 3)] == [0.0, 1.0, 2.5] and all(math.isinf(found[i]) for i in (4, 5, 6, 7))
    assert as_dict(algorithms.wcc(m1).values()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7}
    rank = as_dict(algorithms.pagerank(m1).values())
    expected = {1: 0.326568, 2: 0.170681, 3: 0.343630, 4: 0.032802, 5: 0.032802, 6: 0.060715, 7: 0.032802}
    assert all(abs(rank[i] - v) < 1e-6 for i, v in expected.items())
    assert abs(sum(rank.values()) - 1) < 1e-12


def test_bfs_history(m1):
    assert [r["step"] for r in algorithms.bfs(m1, 1).history] == [0, 1, 2]


def test_triangles_and_clustering(spark):
    m2 = Graph.from_edges(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long"), directed=False)
    assert m2.counts().first().num_edges == 8
    assert as_dict(algorithms.triangles(m2)) == {1: 1, 2: 1, 3: 1, 4: 0}
    lcc = as_dict(algorithms.lcc(m2))
    assert lcc[1] == lcc[2] == 1.0 and abs(lcc[3] - 1 / 3) < 1e-12 and lcc[4] == 0.0


def test_loading_rules(spark):
    edges, listed = spark.createDataFrame([(1, 99)], "src long, dst long"), spark.range(1, 2)
    ids = lambda g: {r.id for r in g.vertices.collect()}
    assert ids(Graph.with_vertices(edges, listed)) == {1}
    assert ids(Graph.from_edges(edges)) == {1, 99}
    assert ids(Graph.with_vertices(edges, listed, directed=False)) == {1, 99}


class One(VertexProgram):
    """Vertex 1 sends 1 along each edge."""

    def initial(self, context: Context):
        return F.lit(0).cast("long")

    def step(self, context: Context):
        sends = (Send(Along.OUT_EDGES, F.lit(1), F.col("id") == 1),) if context.step == 0 else ()
        return PregelStep(F.lit(True), F.col("value") + F.coalesce("msg", F.lit(0)), sends, "sum")


@pytest.mark.parametrize(("directed", "expected", "edges"), [(True, {1: 1, 2: 2}, 3), (False, {1: 2, 2: 2}, 6)])
def test_edges_are_a_multiset(spark, directed, expected, edges):
    g = Graph.from_edges(spark.createDataFrame([(1, 2), (1, 2), (1, 1)], "src long, dst long"), directed)
    assert g.edges.count() == edges
    assert as_dict(run(g, One()).values()) == expected


def test_message_to_unknown_id_keeps_the_run_alive(spark):
    g = Graph.with_vertices(spark.createDataFrame([(1, 99)], "src long, dst long"), spark.range(1, 2))
    result = run(g, One())
    assert [r["computed"] for r in result.history] == [1, 0] and as_dict(result.values()) == {1: 0}


class Counting(UniformProgram):
    aggregators = {"n": Aggregator(F.sum, 0)}

    def initial(self, context: Context):
        return F.lit(None).cast("array<long>")

    def compute(self, context: Context):
        seen = F.lit(context.aggregated["n"]).cast("long")
        value = F.concat(F.coalesce("value", F.array().cast("array<bigint>")), F.array(seen))
        return PregelStep(F.lit(context.step == 2), value, aggregate={"n": F.lit(context.step + 1)})


def test_aggregates_are_read_one_step_later(spark):
    g = Graph.from_edges(spark.createDataFrame([(1, 2)], "src long, dst long"))
    result = run(g, Counting())
    assert as_dict(result.values()) == {1: [0, 2, 4], 2: [0, 2, 4]} and result.aggregated == {"n": 6}


class Undefined(VertexProgram):
    def step(self, context: Context):
        if context.step:
            raise KeyError(context.step)
        return PregelStep(F.lit(False))


def test_undefined_step_ends_the_run(spark):
    g = Graph.from_edges(spark.createDataFrame([(1, 2)], "src long, dst long"))
    with pytest.raises(KeyError):
        run(g, Undefined())
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_pandas_step(spark):
    def least(value, messages, edges, context):  # inside, as executors don't have this module
        new = min([value, *messages])
        send = context.step == 0 or new < value
        return new, True, [(dst, new) for dst, _ in edges] if send else []

    class InPandas(VertexProgram):
        def initial(self, context: Context):
            return F.col("id")

        def step(self, context: Context):
            return PandasStep(least, "long", "long")

    g = Graph.from_edges(spark.createDataFrame([(3, 2), (2, 1), (5, 6)], "src long, dst long"), directed=False)
    assert as_dict(run(g, InPandas()).values()) == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}


def test_state_and_edges_do_not_move(spark):
    """Between supersteps only messages are shuffled."""
    g = Graph.from_edges(spark.createDataFrame([(i, i + 1) for i in range(50)], "src long, dst long"))
    result = algorithms.wcc(g)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = result.state.join(result.state.select(F.col("id").alias("other")), F.col("id") == F.col("other"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan


def test_hubs_are_spread(spark):
    from loomgraph.operators.engine import Edges

    star = spark.range(60_000).select(F.lit(7).cast("long").alias("src"), (F.col("id") + 100).alias("dst"))
    chain = spark.range(1000).select((F.col("id") + 100).alias("src"), (F.col("id") + 101).alias("dst"))
    ways, spread = Edges(star.unionByName(chain), 4).along(Along.OUT_EDGES)
    assert [r[0] for r in spread.collect()] == [7]
    assert ways.filter("src = 7").select("_salt").distinct().count() > 1
    g = Graph.from_edges(star.unionByName(chain))
    assert algorithms.bfs(g, 7).values().filter("value = 1").count() == 60_000


def test_empty_graph(spark):
    g = Graph.from_edges(spark.createDataFrame([], "src long, dst long"))
    assert algorithms.wcc(g).state.count() == 0


def test_run_without_an_end_is_no_result(spark):
    g = Graph.from_edges(spark.createDataFrame([(i, i + 1) for i in range(9)], "src long, dst long"))
    with pytest.raises(RuntimeError, match="3 supersteps"):
        run(g, algorithms.programs.Hops(), {"source_id": 0}, max_steps=3)
    assert len(run(g, algorithms.programs.Hops(), {"source_id": 0}, max_steps=10).history) == 10
    assert inspect.signature(run).parameters["max_steps"].default is None


@pytest.mark.parametrize("order", ["rising", "valley", "shuffled"])
def test_long_chains_take_few_steps(spark, order):
    n = 3000
    ids = list(range(n))
    if order == "valley":  # the smallest id is at the end of a chain whose others fall towards its middle
        ids = [0, *range(n - 1, 1, -2), *range(2, n, 2)]
    elif order == "shuffled":
        random.Random(5).shuffle(ids)
    chain = list(zip(ids, ids[1:]))
    g = Graph.from_edges(spark.createDataFrame([*chain, *((n + a, n + b) for a, b in chain)], "src long, dst long"))
    found = algorithms.wcc(g)
    assert as_dict(found.values().groupBy("value").count()) == {0: len(ids), n + min(ids): len(ids)}
    assert len(found.history) < 60


def test_components_of_random_graphs(spark):
    for seed in range(2):
        r = random.Random(seed)
        pairs = [(r.randrange(400), r.randrange(400)) for _ in range(260)]
        low = {x: x for p in pairs for x in p}
        while any(low[a] != low[b] for a, b in pairs):
            for a, b in pairs:
                low[a] = low[b] = min(low[a], low[b])
        g = Graph.from_edges(spark.createDataFrame(pairs, "src long, dst long"))
        assert as_dict(algorithms.wcc(g).values()) == low


def test_vertices_that_many_ask(spark):
    """A star of more leaves than a partition's share: all ask its centre."""
    star = spark.range(1, 60_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    assert algorithms.wcc(Graph.from_edges(star)).values().filter("value = 0").count() == 60_001


def test_one_superstep_has_tasks_by_its_edges(spark):
    """Its edges and vertices are laid out in more partitions as there are more edges, which adaptive execution leaves apart."""
    import re

    from loomgraph.plans.graph_queries import _all_send

    def laid_out(n):
        edges = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
        plan = _all_send(Graph.from_edges(edges), F.col("value"), "min")._jdf.queryExecution().optimizedPlan().toString()
        return [int(k) for k in re.findall(r"RepartitionByExpression \[\w+#\d+L?\], (\d+)", plan)]

    assert laid_out(1_000) == [4, 4, 4]  # the edges, and the vertices as senders and as receivers
    few, many = laid_out(5_000_000), laid_out(50_000_000)
    assert len(set(many)) == 1 and few[0] > 4 and many[0] >= 9 * few[0]


def test_states_are_written_once_in_buckets(spark):
    """A step's rows are written by one job into files that are read by column, without a cache and a second pass."""
    g = Graph.from_edges(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "src string, dst string"))
    result = algorithms.wcc(g)
    plan = result.state._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "Scan ExistingRDD" not in plan
    assert as_dict(result.values()) == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("superstep")]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


class Spans(VertexProgram):
    """A value of a type that files don't hold."""

    def initial(self, context: Context):
        return F.expr("make_interval(0, 0, 0, CAST(id AS int))")

    def step(self, context: Context):
        sends = (Send(Along.OUT_EDGES, F.lit(1)),) if context.step == 0 else ()
        return PregelStep(F.lit(True), None, sends, "sum")


def test_values_that_files_do_not_hold(spark):
    result = run(Graph.from_edges(spark.createDataFrame([(1, 2)], "src long, dst long")), Spans())
    assert [r["targets"] for r in result.history] == [1, 0]
    assert as_dict(result.values().select("id", F.col("value").cast("string"))) == {1: "1 days", 2: "2 days"}
