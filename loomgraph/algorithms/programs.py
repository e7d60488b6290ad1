"""BFS, PageRank, connected components, shortest paths, label propagation and clustering coefficients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, neighbours
from ..operators.engine import Result, run
from ..operators.program import Aggregator, Along, Context, PregelStep, QueryStep, Send, VertexProgram

UNREACHED = 9223372036854775807


class Components(VertexProgram):
    """The smallest id that edges, in either direction, lead to."""

    def initial(self, context: Context) -> Column:
        return F.col("id")

    def step(self, context: Context) -> PregelStep:
        if context.step == 0:
            return PregelStep(F.lit(True), sends=(Send(Along.BOTH_WAYS, F.col("value")),), combine="min")
        lower = F.col("value") < F.col("old_value")
        return PregelStep(F.lit(True), F.least("value", "msg"), (Send(Along.BOTH_WAYS, F.col("value"), lower),), "min")


class JumpedComponents(VertexProgram):
    """What ``Components`` finds, in rounds of three steps that jump along labels: about the logarithm of the longest way, not its length.

    Each vertex tells its neighbours its label.  One that gets a lower label
    takes it and passes it on to the vertex that its old label names.  Then
    each takes its label's own label.  A round in which nobody gets a lower
    label is the last: labels are equal along every edge, and the smallest id
    keeps its own.
    """

    aggregators = {"lowered": Aggregator(F.sum, 0)}

    def initial(self, context: Context) -> Column:
        return F.col("id")

    def step(self, context: Context) -> PregelStep | QueryStep:
        if context.step % 3 == 0:
            return PregelStep(F.lit(False), sends=(Send(Along.BOTH_WAYS, F.col("value")),), combine="min")
        lower = F.col("value") < F.col("old_value")
        if context.step % 3 == 1:
            return PregelStep(F.lit(False), F.least("value", "msg"), (Send(F.col("old_value"), F.col("value"), lower),), "min", {"lowered": F.when(lower, 1)})
        if not context.aggregated["lowered"]:
            return PregelStep(F.lit(True))
        asked = F.array(F.struct(F.col("value").alias("dst"), F.col("id").alias("s")))
        return QueryStep(asked, F.col("value"), F.lit(False), F.least("value", "msg"), F.least("value", "msg"), F.min)


class Hops(VertexProgram):
    """Edges on the shortest way from ``source_id``."""

    def initial(self, context: Context) -> Column:
        return F.when(F.col("id") == context.params["source_id"], 0).otherwise(F.lit(UNREACHED)).cast("long")

    def step(self, context: Context) -> PregelStep:
        if context.step == 0:
            return PregelStep(F.lit(True), sends=(Send(Along.OUT_EDGES, F.lit(1).cast("long"), F.col("value") == 0),), combine="min")
        nearer = F.col("value") < F.col("old_value")
        return PregelStep(F.lit(True), F.least("value", "msg"), (Send(Along.OUT_EDGES, F.col("value") + 1, nearer),), "min")


class Distances(VertexProgram):
    """The least sum of edge values from ``source_id``; edge values aren't negative."""

    def initial(self, context: Context) -> Column:
        return F.when(F.col("id") == context.params["source_id"], 0.0).otherwise(F.lit(float("inf")))

    def step(self, context: Context) -> PregelStep:
        along = F.col("value") + F.col("e")
        if context.step == 0:
            return PregelStep(F.lit(True), sends=(Send(Along.OUT_EDGES, along, F.col("value") == 0),), combine="min")
        nearer = F.col("value") < F.col("old_value")
        return PregelStep(F.lit(True), F.least("value", "msg"), (Send(Along.OUT_EDGES, along, nearer),), "min")


class Rank(VertexProgram):
    """PageRank over ``numIterations`` with ``dampingFactor``; what sinks hold is shared by all."""

    aggregators = {"sinks": Aggregator(F.sum, 0.0)}

    def vertex_columns(self, graph: Graph) -> DataFrame:
        return graph.out_degrees()

    def initial(self, context: Context) -> Column:
        return F.lit(1.0 / max(1, context.num_vertices))

    def step(self, context: Context) -> PregelStep:
        d, n, last = context.params.get("dampingFactor", 0.85), max(1, context.num_vertices), context.params.get("numIterations", 10)
        value = None
        if context.step:
            value = F.lit((1 - d) / n) + d * (F.coalesce("msg", F.lit(0.0)) + F.lit((context.aggregated["sinks"] or 0.0) / n))
        more = context.step < last
        share = F.col("value") / F.col("out_degree")
        return PregelStep(F.lit(not more), value, (Send(Along.OUT_EDGES, share),) if more else (), "sum", {"sinks": F.when(F.col("out_degree") == 0, F.col("value"))})


class Labels(VertexProgram):
    """Community detection by label propagation over ``numIterations``: the smallest of the most frequent labels next to a vertex."""

    def initial(self, context: Context) -> Column:
        return F.col("id")

    def step(self, context: Context) -> PregelStep:
        more = context.step < context.params.get("numIterations", 10)
        value = F.coalesce("msg", "value") if context.step else None
        return PregelStep(F.lit(not more), value, (Send(Along.BOTH_WAYS, F.col("value")),) if more else (), "mode")


def wcc(graph: Graph) -> Result:
    return run(graph, JumpedComponents())


def bfs(graph: Graph, source_id: int) -> Result:
    return run(graph, Hops(), {"source_id": source_id})


def sssp(graph: Graph, source_id: int) -> Result:
    return run(graph, Distances(), {"source_id": source_id})


def pagerank(graph: Graph, damping: float = 0.85, iterations: int = 10) -> Result:
    return run(graph, Rank(), {"dampingFactor": damping, "numIterations": iterations})


def cdlp(graph: Graph, iterations: int = 10) -> Result:
    return run(graph, Labels(), {"numIterations": iterations})


def _closed(edges: DataFrame) -> DataFrame:
    """``a, b, c``: each triangle of the simple undirected graph once.

    Edges point from the end of lower degree to the other, so a vertex of very
    many edges has few that leave it, and pairs of these stay few.
    """
    pairs = neighbours(edges)
    degree = pairs.groupBy("src").agg(F.count("*").alias("n"))
    ranked = pairs.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("n").alias("m")), "dst")
    up = ranked.filter((F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("src") < F.col("dst")))).select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("m"))
    one, two = up.select("a", "b", "m"), up.select("a", F.col("b").alias("c"), F.col("m").alias("k"))
    wedge = one.join(two, "a").filter((F.col("m") < F.col("k")) | ((F.col("m") == F.col("k")) & (F.col("b") < F.col("c")))).select("a", "b", "c")
    return wedge.join(up.select(F.col("a").alias("b"), F.col("b").alias("c")), ["b", "c"], "left_semi").select("a", "b", "c")


def triangles(graph: Graph) -> DataFrame:
    """``id, triangles``: the triangles of the simple undirected graph through each vertex."""
    corners = _closed(graph.edges).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return graph.vertices.join(corners, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("triangles"))


def lcc(graph: Graph) -> DataFrame:
    """``id, lcc``: of the ordered pairs of a vertex's neighbours, the share that an edge joins.

    In a directed graph each direction of an edge between neighbours counts.
    """
    simple = graph.edges.select("src", "dst").filter("src <> dst").distinct()
    degree = neighbours(graph.edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    found = _closed(graph.edges)
    sides = found.select(F.explode(F.array(*[F.struct(F.col(x).alias("id"), F.col(y).alias("p"), F.col(z).alias("q")) for x, y, z in (("a", "b", "c"), ("b", "a", "c"), ("c", "a", "b"))])).alias("t")).select("t.*")
    # How many of the two directions each opposite side has.
    ways = simple.select(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).groupBy("lo", "hi").agg(F.count("*").alias("ways"))
    links = sides.withColumn("lo", F.least("p", "q")).withColumn("hi", F.greatest("p", "q")).join(ways, ["lo", "hi"]).groupBy("id").agg(F.sum("ways").alias("links"))
    both = graph.vertices.join(degree, "id", "left").join(links, "id", "left")
    share = F.coalesce("links", F.lit(0)) / (F.col("k") * (F.col("k") - 1))
    return both.select("id", F.when(F.col("k") > 1, share).otherwise(0.0).alias("lcc"))
