"""Queries over loading, supersteps, algorithms and partitioners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import algorithms
from ..algorithms.programs import Components
from ..functions import partitioning
from ..graph import Graph, undirected
from ..operators.engine import active_by_step, combine, computed, outbox, run, with_inbox
from ..operators.program import Aggregator, Along, Context, PregelStep, QueryStep, Send, VertexProgram
from . import graphs
from .graphs import GEO_SQL, ORDERS_SQL, PARTS_SQL, USERS_SQL

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Loading


@query(f"WITH {ORDERS_SQL} SELECT src AS id FROM e UNION SELECT dst FROM e")
def load_edges_only_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph.from_edges(graphs.order_edges(spark, sf_dir)).vertices


@query(f"WITH {ORDERS_SQL} SELECT id FROM v UNION SELECT src FROM e")
def load_with_vertex_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.order_chains(spark, sf_dir).vertices


@query(f"WITH {ORDERS_SQL} SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e")
def undirected_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return undirected(graphs.order_edges(spark, sf_dir))


@query(f"WITH {PARTS_SQL} SELECT (SELECT count(*) FROM v) AS num_vertices, (SELECT count(*) FROM e) AS num_edges")
def graph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.parts_and_suppliers(spark, sf_dir).counts()


@query(f"""WITH {USERS_SQL}, o AS (SELECT src AS id, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY 1)
    SELECT v.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM v LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.users(spark, sf_dir).degrees()


@query(f"WITH {GEO_SQL}, o AS (SELECT src AS id, count(*) AS n FROM e GROUP BY 1), i AS (SELECT dst AS id, count(*) AS n FROM e GROUP BY 1) SELECT v.id, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree FROM v LEFT JOIN o USING (id) LEFT JOIN i USING (id)")
def geography_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.geography(spark, sf_dir).degrees()


# One superstep


_PARTITION_BYTES = 2 << 20


def _partitions(edges: DataFrame) -> int:
    """As many partitions as keep a task's share of the edges the same at every size; adaptive execution would join small ones by their compressed size, in which millions of edges are few bytes."""
    size = int(str(edges._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // _PARTITION_BYTES)


def _all_send(graph: Graph, message, how: str, along: Along = Along.OUT_EDGES) -> DataFrame:
    """What each vertex has in its inbox after every vertex has sent ``message`` along its edges."""
    n = _partitions(graph.edges)
    state = graph.vertices.select("id", F.col("id").alias("value"), F.lit(False).alias("halted")).repartition(n, "id")
    done = computed(with_inbox(state, None), None, F.lit(True))
    edges = (graph.edges if along is Along.OUT_EDGES else undirected(graph.edges)).repartition(n, "src")
    inbox = combine(outbox(done, edges, (Send(Along.OUT_EDGES, message),)), how)
    return with_inbox(state, inbox).filter("has_msg")


@query(f"WITH {USERS_SQL} SELECT dst AS id, sum(src)::BIGINT AS msg FROM e GROUP BY dst")
def sendall_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_send(graphs.users(spark, sf_dir), F.col("value"), "sum").select("id", "msg")


@query(f"WITH {PARTS_SQL} SELECT dst AS id, min(src) AS msg FROM e GROUP BY dst")
def sendall_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_send(graphs.parts_and_suppliers(spark, sf_dir), F.col("value"), "min").select("id", "msg")


@query(f"WITH {USERS_SQL} SELECT dst AS id, max(round(src * e, 6)) AS msg FROM e GROUP BY dst")
def sendall_max_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_send(graphs.users(spark, sf_dir), F.round(F.col("value") * F.col("e"), 6), "max").select("id", "msg")


@query(f"WITH {GEO_SQL} SELECT dst AS id, count(*) AS msg FROM e GROUP BY dst")
def sendall_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all_send(graphs.geography(spark, sf_dir), F.lit(1), "count").select("id", "msg")


@query(f"WITH {ORDERS_SQL}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) SELECT dst AS id, string_agg(src::VARCHAR, ',' ORDER BY src) AS messages FROM b GROUP BY dst")
def sendall_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a combiner a vertex sees each message."""
    got = _all_send(graphs.order_chains(spark, sf_dir), F.col("value"), "collect", Along.BOTH_WAYS)
    return got.select("id", F.array_join(F.array_sort("msg").cast("array<string>"), ",").alias("messages"))


@query(f"WITH {ORDERS_SQL}, m AS (SELECT id // 2 AS dst, count(*) AS msg FROM v WHERE id % 3 = 0 GROUP BY 1) SELECT id, coalesce(msg, 0) AS messages FROM v LEFT JOIN m ON id = dst")
def targeted_send(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third vertex sends to half its id, whether or not an edge leads there."""
    vertices = graphs.order_chains(spark, sf_dir).vertices
    state = vertices.select("id", F.col("id").alias("value"), F.lit(False).alias("halted"))
    done = computed(with_inbox(state, None), None, F.lit(True))
    sent = combine(outbox(done, None, (Send(F.expr("id div 2"), F.lit(1), F.col("id") % 3 == 0),)), "count")
    return with_inbox(state, sent).select("id", F.coalesce("msg", F.lit(0)).alias("messages"))


class _ToNobody(VertexProgram):
    """Step 0 sends to ids that don't exist, and halts."""

    def initial(self, context: Context):
        return F.lit(0).cast("long")

    def step(self, context: Context) -> PregelStep:
        sends = (Send(F.col("id") + 1_000_000_000, F.lit(1)),) if context.step == 0 else ()
        return PregelStep(F.lit(True), F.col("value") + F.coalesce("msg", F.lit(0)), sends, "sum")


@query(f"WITH {ORDERS_SQL}, n AS (SELECT count(*) AS n FROM v) SELECT 0 AS step, n AS computed, n AS targets FROM n UNION ALL SELECT 1, 0, 0 FROM n")
def unknown_target_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run goes on for one more step, in which nobody has a message."""
    return active_by_step(spark, run(graphs.order_chains(spark, sf_dir), _ToNobody()).history)


# Algorithms


@query("SELECT o_orderkey AS id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders")
def wcc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.wcc(graphs.order_chains(spark, sf_dir)).values("component")


_CHAIN_ORDER = "SELECT o_orderkey AS id, o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders"


@query(f"""
    WITH RECURSIVE p AS ({_CHAIN_ORDER}),
    -- In step s a vertex has its component's smallest id if that lies within s edges; it is computed while news reaches it.
    m AS MATERIALIZED (SELECT a.id, abs(a.k - b.k) AS d, b.id AS low FROM p a JOIN p b ON a.c = b.c),
    news AS (SELECT id, d FROM (SELECT id, d, low, min(low) OVER (PARTITION BY id ORDER BY d, low ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m) WHERE before IS NULL OR low < before),
    told AS (SELECT DISTINCT id, d FROM news),
    sent AS (SELECT told.d AS step, count(DISTINCT q.id) AS targets FROM told JOIN p ON p.id = told.id JOIN p q ON q.c = p.c AND abs(q.k - p.k) = 1 GROUP BY 1),
    steps AS (SELECT step + 1 AS step, targets AS computed FROM sent UNION ALL SELECT 0, count(*) FROM p)
    SELECT steps.step::INTEGER AS step, computed, coalesce(sent.targets, 0) AS targets FROM steps LEFT JOIN sent USING (step)""")
def active_vertices_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices computed in each step of the components of the order chains, and vertices that got messages."""
    return active_by_step(spark, run(graphs.order_chains(spark, sf_dir), Components()).history)


@query(f"""WITH RECURSIVE {PARTS_SQL}, s AS (SELECT DISTINCT src, dst FROM e), r AS (
        SELECT 0::BIGINT AS id, 0::BIGINT AS d UNION SELECT s.dst, r.d + 1 FROM r JOIN s ON s.src = r.id WHERE r.d < 8)
    SELECT v.id, coalesce(min(d), 9223372036854775807) AS hops FROM v LEFT JOIN r USING (id) GROUP BY v.id""")
def bfs_bipartite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.bfs(graphs.parts_and_suppliers(spark, sf_dir), 0).values("hops")


_BOUND = 24
_RELAX = ",\n".join(f"    d{k + 1} AS MATERIALIZED (SELECT id, min(d) AS d FROM (SELECT id, d FROM d{k} UNION ALL SELECT w.dst, d + w.e FROM d{k} JOIN w ON w.src = d{k}.id) GROUP BY id)" for k in range(_BOUND))


@query(f"""WITH {USERS_SQL}, w AS MATERIALIZED (SELECT src, dst, min(e) AS e FROM e GROUP BY ALL), d0 AS (SELECT min(id) AS id, 0::DOUBLE AS d FROM v),
{_RELAX}
    SELECT v.id, round(d, 6) AS distance FROM v LEFT JOIN d{_BOUND} USING (id)""")
def sssp_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least sums of event values along user successions; null where there is no way."""
    graph = graphs.users(spark, sf_dir)
    source = graph.vertices.agg(F.min("id")).first()[0]
    found = algorithms.sssp(graph, source).values("distance")
    return found.select("id", F.when(F.col("distance") != float("inf"), F.round("distance", 6)).alias("distance"))


def _rank_sql(vertices: str, iterations: int, d: float = 0.85) -> str:
    steps = "".join(
        f""",
    r{k + 1} AS MATERIALIZED (SELECT v.id, {1 - d} / n + {d} * (coalesce(i.s, 0) + (SELECT coalesce(sum(r), 0) FROM r{k} LEFT JOIN o USING (id) WHERE o.k IS NULL) / n) AS r
        FROM v CROSS JOIN c LEFT JOIN (SELECT e.dst AS id, sum(r{k}.r / o.k) AS s FROM e JOIN r{k} ON r{k}.id = e.src JOIN o ON o.id = e.src GROUP BY 1) i ON i.id = v.id)"""
        for k in range(iterations)
    )
    return f"WITH {vertices}, o AS (SELECT src AS id, count(*) AS k FROM e GROUP BY 1), c AS (SELECT count(*)::DOUBLE AS n FROM v), r0 AS (SELECT id, 1 / n AS r FROM v CROSS JOIN c){steps}\n    SELECT id, round(r, 9) AS rank FROM r{iterations}"


@query(_rank_sql(USERS_SQL, 10))
def pagerank_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = algorithms.pagerank(graphs.users(spark, sf_dir), iterations=10).values("rank")
    return found.select("id", F.round("rank", 9).alias("rank"))


@query(_rank_sql(GEO_SQL, 4))
def pagerank_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are sinks, whose rank goes to all."""
    found = algorithms.pagerank(graphs.geography(spark, sf_dir), iterations=4).values("rank")
    return found.select("id", F.round("rank", 9).alias("rank"))


_CDLP = "".join(
    f""",
    l{k + 1} AS MATERIALIZED (SELECT v.id, coalesce(m.l, l{k}.l) AS l FROM v JOIN l{k} USING (id) LEFT JOIN (
        SELECT id, l FROM (SELECT b.dst AS id, l{k}.l, row_number() OVER (PARTITION BY b.dst ORDER BY count(*) DESC, l{k}.l) AS k FROM b JOIN l{k} ON l{k}.id = b.src GROUP BY b.dst, l{k}.l) WHERE k = 1) m USING (id))"""
    for k in range(3)
)


@query(f"WITH {USERS_SQL}, b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), l0 AS (SELECT id, id AS l FROM v){_CDLP} SELECT id, l AS label FROM l3")
def cdlp_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.cdlp(graphs.users(spark, sf_dir), iterations=3).values("label")


_SIMPLE = "b AS (SELECT src, dst FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst)"


@query(f"WITH {USERS_SQL}, {_SIMPLE}, t AS (SELECT x.src AS id, count(*) // 2 AS n FROM b x JOIN b y ON y.src = x.src JOIN b z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1) SELECT v.id, coalesce(n, 0)::BIGINT AS triangles FROM v LEFT JOIN t USING (id)")
def triangle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return algorithms.triangles(graphs.users(spark, sf_dir))


@query(f"""WITH {USERS_SQL}, {_SIMPLE}, s AS (SELECT DISTINCT src, dst FROM e WHERE src <> dst), k AS (SELECT src AS id, count(*) AS k FROM b GROUP BY 1),
    t AS (SELECT x.src AS id, count(*) AS n FROM b x JOIN b y ON y.src = x.src JOIN s ON s.src = x.dst AND s.dst = y.dst GROUP BY 1)
    SELECT v.id, round(CASE WHEN k.k > 1 THEN coalesce(t.n, 0) / (k.k * (k.k - 1))::DOUBLE ELSE 0 END, 9) AS lcc FROM v LEFT JOIN k USING (id) LEFT JOIN t USING (id)""")
def lcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = algorithms.lcc(graphs.users(spark, sf_dir))
    return found.select("id", F.round("lcc", 9).alias("lcc"))


# Query, answer, process


class _Elders(VertexProgram):
    """Each vertex asks its successors for their values, after all have written their own."""

    def __init__(self, edges: DataFrame):
        self.edges = edges

    def vertex_columns(self, graph: Graph) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("next"))

    def initial(self, context: Context):
        return F.lit(0).cast("long")

    def step(self, context: Context) -> QueryStep:
        asked = F.transform(F.coalesce("next", F.array().cast("array<bigint>")), lambda d: F.struct(d.alias("dst"), F.col("id").alias("s")))
        return QueryStep(asked, F.col("value") + F.col("s"), F.lit(True), F.coalesce("msg", F.lit(-1)), F.col("id") * 2, F.sum)


@query(f"WITH {USERS_SQL}, s AS (SELECT DISTINCT src, dst FROM e) SELECT v.id, coalesce(sum(2 * dst + src), -1)::BIGINT AS answers FROM v LEFT JOIN s ON s.src = v.id GROUP BY v.id")
def qap_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = graphs.users(spark, sf_dir)
    return run(graph, _Elders(graph.edges)).values("answers")


class _CommonNeighbours(VertexProgram):
    """Each vertex asks every successor how many of its own successors that one has as well."""

    def __init__(self, edges: DataFrame):
        self.edges = edges

    def vertex_columns(self, graph: Graph) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("next"))

    def initial(self, context: Context):
        return F.lit(0).cast("long")

    def step(self, context: Context) -> QueryStep:
        own = F.coalesce("next", F.array().cast("array<bigint>"))
        asked = F.transform(own, lambda d: F.struct(d.alias("dst"), own.alias("s")))
        common = F.size(F.array_intersect(F.coalesce("out", F.array().cast("array<bigint>")), "s")).cast("long")
        return QueryStep(asked, common, F.lit(True), F.coalesce("msg", F.lit(0)), gather=F.sum, reads_edges=True)


@query(f"WITH {USERS_SQL}, s AS (SELECT DISTINCT src, dst FROM e), w AS (SELECT src AS id FROM s UNION SELECT dst FROM s), t AS (SELECT x.src AS id, count(*) AS n FROM s x JOIN s y ON y.src = x.src JOIN s z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1) SELECT w.id, coalesce(t.n, 0)::BIGINT AS common FROM w LEFT JOIN t USING (id)")
def qap_common_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    graph = graphs.users(spark, sf_dir)
    return run(graph, _CommonNeighbours(graph.edges)).values("common")


# Aggregators


class _SinkMass(VertexProgram):
    aggregators = {"sinks": Aggregator(F.sum, 0)}

    def vertex_columns(self, graph: Graph) -> DataFrame:
        return graph.out_degrees()

    def initial(self, context: Context):
        return F.lit(0).cast("long")

    def step(self, context: Context) -> PregelStep:
        seen = F.lit(context.aggregated["sinks"] or 0).cast("long")
        return PregelStep(F.lit(context.step == 1), seen, aggregate={"sinks": F.when(F.col("out_degree") == 0, F.col("id"))})


@query(f"WITH {GEO_SQL} SELECT id, (SELECT sum(id) FROM v WHERE id NOT IN (SELECT src FROM e))::BIGINT AS seen FROM v")
def aggregator_dangling_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vertex sees in step 1 what sinks gave in step 0."""
    return run(graphs.geography(spark, sf_dir), _SinkMass()).values("seen")


class _Persistent(VertexProgram):
    aggregators = {"all": Aggregator(F.sum, 0, True, lambda a, b: a + b), "each": Aggregator(F.sum, 0)}

    def initial(self, context: Context):
        return F.lit(0).cast("long")

    def step(self, context: Context) -> PregelStep:
        return PregelStep(F.lit(context.step == 2), aggregate={"all": F.lit(context.step + 1), "each": F.lit(context.step + 1)})


@query(f"WITH {ORDERS_SQL}, n AS (SELECT count(*) AS n FROM v) SELECT s::INTEGER AS step, (n * (s + 1) * (s + 2) // 2)::BIGINT AS persistent, (n * (s + 1))::BIGINT AS each_step FROM n, range(3) t(s)")
def aggregator_persistent_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = run(graphs.order_chains(spark, sf_dir), _Persistent()).history
    return spark.createDataFrame([(r["step"], r["aggregated"]["all"], r["aggregated"]["each"]) for r in history], "step int, persistent long, each_step long")


# Edges that change


class _Doubled(VertexProgram):
    """Doubles the values of its out-edges, adds an edge to itself, then sums what comes along the changed edges."""

    def initial(self, context: Context):
        return F.lit(0.0)

    def step(self, context: Context) -> PregelStep:
        if context.step == 0:
            return PregelStep(F.lit(False), edge_value=F.col("e") * 2, add_edges=((F.col("id"), F.lit(0.5), None),))
        if context.step == 1:
            return PregelStep(F.lit(True), sends=(Send(Along.OUT_EDGES, F.col("e")),), combine="sum")
        return PregelStep(F.lit(True), F.coalesce("msg", F.lit(0.0)), combine="sum")


@query(f"WITH {USERS_SQL}, i AS (SELECT dst AS id, sum(2 * e) AS s FROM e GROUP BY 1) SELECT id, round(coalesce(s, 0) + 0.5, 6) AS total FROM v LEFT JOIN i USING (id)")
def changed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run(graphs.users(spark, sf_dir), _Doubled()).values("total")
    return found.select("id", F.round("total", 6).alias("total"))


# Partitioners


@query("SELECT o_orderkey AS id, (o_orderkey % 10)::INTEGER AS worker FROM orders")
def partition_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = graphs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return ids.select("id", partitioning.by_hash(F.col("id"), 10).alias("worker"))


@query("SELECT o_orderkey AS id, (CASE WHEN o_orderkey % 12 >= 11 THEN o_orderkey % 12 WHEN o_orderkey % 11 >= 10 THEN o_orderkey % 11 ELSE o_orderkey % 10 END)::INTEGER AS worker FROM orders")
def partition_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = graphs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    grown = partitioning.naive(F.col("id"), partitioning.by_hash(F.col("id"), 10), 10, 11)
    return ids.select("id", partitioning.naive(F.col("id"), grown, 11, 12).alias("worker"))


@query("SELECT o_orderkey AS id, (CASE WHEN o_orderkey % 10 = 3 AND o_orderkey % 20 = 0 THEN 10 WHEN o_orderkey % 10 = 2 AND o_orderkey % 12 = 0 THEN 10 WHEN o_orderkey % 10 = 6 AND o_orderkey % 14 = 0 THEN 10 ELSE o_orderkey % 10 END)::INTEGER AS worker FROM orders")
def partition_rehash_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = graphs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    moves = {3: [(10, 0.0506)], 2: [(10, 0.0860)], 6: [(10, 0.0740)]}
    return ids.select("id", partitioning.rehash_last(F.col("id"), partitioning.by_hash(F.col("id"), 10), moves).alias("worker"))


@query("SELECT o_orderkey AS id, (CASE WHEN o_orderkey % 10 = 3 AND o_orderkey % 4 = 1 THEN (CASE o_orderkey % 2 WHEN 0 THEN 10 ELSE 11 END) WHEN o_orderkey % 10 = 7 AND o_orderkey % 3 = 2 THEN 10 ELSE o_orderkey % 10 END)::INTEGER AS worker FROM orders")
def partition_rehash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = graphs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    moves = {3: ([10, 11], 0.25, 1), 7: ([10], 0.4, 2)}
    return ids.select("id", partitioning.rehash(F.col("id"), partitioning.by_hash(F.col("id"), 10), moves).alias("worker"))
