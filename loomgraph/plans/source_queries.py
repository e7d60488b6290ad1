"""Queries over sources, sinks and the program surface: tables go out as lines or Parquet and come back through the readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import metrics as m
from ..operators.engine import run
from ..operators.program import Along, Context, PregelStep, Send, UniformProgram, VertexProgram
from ..sources import results, text
from ..sources.shared import scratch
from . import graphs, metric_queries
from .graphs import GEO_SQL, ORDERS_SQL, PARTS_SQL, USERS_SQL
from .metric_queries import _WHOLE, EVENTS, RUNS, _whole_performance

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _lines(df: DataFrame, *columns: str | Column) -> str:
    """The path of a file of lines, the columns of ``df`` with one blank between them."""
    path = scratch(df.sparkSession, "lines")
    df.select(F.concat_ws(" ", *[F.col(c).cast("string") if isinstance(c, str) else c for c in columns]).alias("value")).write.text(path)
    return path


# Sources


@query(f"WITH {ORDERS_SQL} SELECT src, dst FROM e")
def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_edges(spark, _lines(graphs.order_edges(spark, sf_dir), "src", "dst"))


@query(f"WITH {USERS_SQL} SELECT src, dst, round(e, 6) AS e FROM e")
def weighted_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.read_edges(spark, _lines(graphs.user_edges(spark, sf_dir), "src", "dst", "e"), weighted=True)
    return found.select("src", "dst", F.round("e", 6).alias("e"))


@query(f"WITH {PARTS_SQL} SELECT src, dst, TRUE AS e FROM one")
def constant_edge_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_edges(spark, _lines(graphs.part_supplier_edges(spark, sf_dir), "src", "dst"), constant=True)


@query("SELECT o_orderkey AS id FROM orders")
def vertex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.read_vertices(spark, _lines(graphs.table(spark, sf_dir, "orders"), "o_orderkey"))


@query("SELECT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_orderkey % 3 <> 0")
def permissive_edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third line has no number where the source should be, and is left out."""
    src = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("#"), F.col("o_orderkey").cast("string"))).otherwise(F.col("o_orderkey").cast("string"))
    return text.read_edges(spark, _lines(graphs.table(spark, sf_dir, "orders"), src, "o_custkey"), permissive=True)


@query(f"WITH {GEO_SQL}, o AS (SELECT src AS id FROM e UNION SELECT src FROM e UNION SELECT c_custkey + 1000 FROM customer) SELECT count(*) AS num_vertices, (SELECT count(*) FROM e) AS num_edges FROM o")
def lines_to_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge and vertex lines loaded together: listed ids and sources exist."""
    edges = text.read_edges(spark, _lines(graphs.geography(spark, sf_dir).edges, "src", "dst"))
    ids = text.read_vertices(spark, _lines(graphs.table(spark, sf_dir, "customer"), F.col("c_custkey") + 1000))
    return Graph.with_vertices(edges, ids).counts()


@query("SELECT 'policy.' || o_orderkey AS key, o_orderpriority AS text FROM orders WHERE o_orderkey % 5 <> 0")
def property_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both separators, blanks around them, and comments."""
    key = F.concat(F.when(F.col("o_orderkey") % 5 == 0, F.lit("# ")).otherwise(F.lit(" ")), F.lit("policy."), F.col("o_orderkey").cast("string"))
    mark = F.when(F.col("o_orderkey") % 2 == 0, F.lit(" = ")).otherwise(F.lit(": "))
    path = scratch(spark, "lines")
    graphs.table(spark, sf_dir, "orders").select(F.concat(key, mark, F.col("o_orderpriority"), F.lit("  ")).alias("value")).write.text(path)
    return results.read_properties(spark, path).select("key", "text")


def _by_run(df: DataFrame, line: Column) -> str:
    """A folder of log lines for each run, one file in each."""
    path = scratch(df.sparkSession, "logs")
    df.select("run", line.alias("value")).repartition("run").write.partitionBy("run").text(path)
    return path


def _run_of(file: str = "file") -> Column:
    return F.regexp_extract(file, r"run=([^/]+)/", 1).alias("run")


@query(f"WITH {EVENTS} SELECT run, bool_or(event_id % 97 = 0) AS valid, min(CASE WHEN event_type = 'click' THEN event_id END) AS processing_ms, min(CASE WHEN event_type = 'view' THEN event_id END) AS makespan_ms FROM ev GROUP BY run")
def benchmark_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a run's log: what tells that it was valid, and its times."""
    number = F.col("event_id").cast("string")
    line = F.when(F.col("event_id") % 97 == 0, F.lit("INFO " + results.VALID + ".")).otherwise(F.lit("INFO nothing"))
    timed = F.when(F.col("event_type") == "click", F.concat(F.lit("ProcessingTime: "), number)).when(F.col("event_type") == "view", F.concat(F.lit("the run took "), number, F.lit(" ms."))).otherwise(F.lit(""))
    path = _by_run(metric_queries.events(spark, sf_dir).withColumn("line", F.explode(F.array(line, timed))), F.col("line"))
    return results.read_logs(spark, path).select(_run_of(), "valid", "processing_ms", "makespan_ms")


@query(f"WITH {EVENTS} SELECT run, min(ms) AS first_ms, max(ms) AS last_ms FROM ev WHERE event_id % 4 <> 0 GROUP BY run")
def container_log_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last stamp of each run's container log; every fourth line has none."""
    stamp = F.date_format(F.timestamp_millis("ms"), "MM/dd/yyyy HH:mm:ss.SSS")
    line = F.when(F.col("event_id") % 4 == 0, F.lit("  at some place")).otherwise(F.concat(F.lit("[INFO] ["), stamp, F.lit("] [worker] step")))
    return results.container_times(spark, _by_run(metric_queries.events(spark, sf_dir), line)).select(_run_of(), "first_ms", "last_ms")


@query("SELECT o_orderkey AS run, CASE o_orderkey % 4 WHEN 0 THEN 'WCP' WHEN 1 THEN 'NP' WHEN 2 THEN 'Reg' ELSE 'UNKNOWN' END AS policy FROM orders")
def short_policy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.element_at(F.array(*map(F.lit, ("WallClockPolicy", "NetworkPolicy", "Reg", "SomethingElse"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return graphs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), results.short_policy(F.concat(F.lit("org.example."), last)).alias("policy"))


# Sinks


@query(f"WITH {USERS_SQL}, o AS (SELECT src AS id, count(*) AS n FROM e GROUP BY 1) SELECT v.id::VARCHAR || ' ' || coalesce(o.n, 0)::VARCHAR AS value FROM v LEFT JOIN o USING (id)")
def written_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for each vertex, in place of what an earlier write has left."""
    state = graphs.users(spark, sf_dir).out_degrees().withColumnRenamed("out_degree", "value")
    path = scratch(spark, "vertices")
    text.write_vertices(state.withColumn("value", F.lit("old")), path)
    text.write_vertices(state, path)
    return spark.read.text(path)


@query(f"WITH {EVENTS} SELECT run, seq, step, time_ms, supply, demand FROM sd")
def metrics_written_and_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "metrics")
    text.write_metrics({"supply_demand": metric_queries.supply_demand(spark, sf_dir), "worker_state": metric_queries.states(spark, sf_dir)}, path)
    return text.read_metrics(spark, path, ("supply_demand",))["supply_demand"]


# The program surface


class _Sums(UniformProgram):
    """One function for both steps: send the id, then add up what came."""

    def initial(self, context: Context):
        return F.lit(0).cast("long")

    def compute(self, context: Context) -> PregelStep:
        got = F.aggregate(F.coalesce(F.col("msg"), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x) if context.step else None
        return PregelStep(F.lit(True), got, (Send(Along.OUT_EDGES, F.col("id")),) if context.step == 0 else ())


@query(f"WITH {USERS_SQL}, i AS (SELECT dst AS id, sum(src)::BIGINT AS s FROM e GROUP BY 1) SELECT v.id, coalesce(i.s, 0) AS total FROM v LEFT JOIN i USING (id)")
def uniform_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertices without messages halt in step 0 and keep their 0."""
    return run(graphs.users(spark, sf_dir), _Sums()).values("total")


class _Hooked(VertexProgram):
    """Parameters are loaded once; what runs before and after each step changes the next step's addend."""

    def __init__(self):
        self.factor, self.addend, self.seen = 0, 0, 0

    def load(self, params: dict) -> None:
        self.factor = params["factor"]

    def initial(self, context: Context):
        return F.col("id")

    def before_step(self, context: Context) -> None:
        self.addend = self.factor * (context.step + 1)

    def after_step(self, context: Context, record: dict) -> None:
        self.seen += record["computed"]

    def step(self, context: Context) -> PregelStep:
        if context.step == 3:
            return PregelStep(F.lit(True), F.col("value") * 2)
        return PregelStep(F.lit(False), F.col("value") + self.addend + self.seen)


@query(f"WITH {GEO_SQL}, n AS (SELECT count(*) AS n FROM v) SELECT id, 2 * (id + 7 + (14 + n) + (21 + 2 * n))::BIGINT AS value FROM v, n")
def hooks_and_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(graphs.geography(spark, sf_dir), _Hooked(), {"factor": 7}).values()


class _Retargeted(VertexProgram):
    """Even vertices turn their edges to the next id."""

    def step(self, context: Context) -> PregelStep:
        return PregelStep(F.lit(True), edge_target=F.when(F.col("src") % 2 == 0, F.col("dst") + 1).otherwise(F.col("dst")))


@query(f"WITH {ORDERS_SQL} SELECT src, CASE WHEN src % 2 = 0 THEN dst + 1 ELSE dst END AS dst FROM e")
def edge_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(graphs.order_chains(spark, sf_dir), _Retargeted()).edges.select("src", "dst")


# Order and position


@query(f"WITH {EVENTS} SELECT run, max(worker) AS worker FROM st GROUP BY run")
def largest_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_queries.states(spark, sf_dir).groupBy("run").agg(F.max("worker").alias("worker"))


@query(f"WITH {_WHOLE} SELECT policy, score, row_number() OVER (ORDER BY score DESC, policy)::INTEGER AS place FROM ps ORDER BY score DESC, policy")
def policies_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best first; a row for each policy."""
    return m.by_score(_whole_performance(spark, sf_dir), "policy")


@query(f"WITH {RUNS} SELECT dataset, policy, processing_s, run FROM ru ORDER BY dataset, policy, processing_s, run")
def runs_by_several_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_queries.runs(spark, sf_dir).select("dataset", "policy", "processing_s", "run").orderBy("dataset", "policy", "processing_s", "run")


@query(f"""WITH {EVENTS}, b AS (SELECT run, step, count(*) AS n FROM sd GROUP BY ALL), a AS (SELECT run, step, n, row_number() OVER (PARTITION BY run ORDER BY step)::INTEGER AS k FROM b)
    SELECT x.run, x.k AS position, x.step AS step, y.step AS then_step, y.n - x.n AS change FROM a x JOIN a y ON x.run = y.run AND y.k = x.k + 1""")
def zipped_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run's series of steps beside itself, one place on."""
    steps = metric_queries.supply_demand(spark, sf_dir).groupBy("run", "step").agg(F.count("*").alias("n"))
    series = steps.withColumn("position", F.row_number().over(Window.partitionBy("run").orderBy("step")))
    later = series.select("run", (F.col("position") - 1).alias("position"), F.col("step").alias("then_step"), F.col("n").alias("then_n"))
    return m.zipped(series, later, "run").select("run", "position", "step", "then_step", (F.col("then_n") - F.col("n")).alias("change"))
