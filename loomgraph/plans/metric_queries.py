"""Queries over the run-metric operators, on run tables derived from the driver's events and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import metrics as m
from .graphs import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Run tables: runs and workers are users' groups, steps are days, operations are event types.

_OPS = {"view": "RUN_SUPERSTEP", "click": "BARRIER", "error": "DISTRIBUTE_DATA", "purchase": "LOAD_DATA", "signup": "PREPARE_FIRST_SUPERSTEP"}
_OP_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _OPS.items()) + " END"


def _millis(c: str) -> Column:
    """Milliseconds since 1970 of a timestamp without a time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c}) div 1000")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    run = F.concat(F.lit("r"), (F.expr("user_id div 5") % 6).cast("string"))
    return e.select("event_id", "event_type", "value", run.alias("run"), (F.day("ts") - 1).alias("step"), (F.col("user_id") % 5).alias("worker"), _millis("ts").alias("ms"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.lit(None).cast("string")
    for k, v in _OPS.items():
        op = F.when(F.col("event_type") == k, v).otherwise(op)
    stop = F.when(F.col("event_id") % 17 != 0, F.col("ms") + F.round(F.col("value") * 1000).cast("long"))
    return events(spark, sf_dir).select("run", "step", "worker", op.alias("op"), F.col("ms").alias("start_ms"), stop.alias("stop_ms"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("run", "step", "worker", F.col("ms").alias("ts_ms"), F.col("event_type").alias("metric"), "value")


def supply_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("run").orderBy("ms", "event_id"))
    rows = events(spark, sf_dir).filter("event_type = 'error'")
    return rows.select("run", seq.alias("seq"), "step", F.col("ms").alias("time_ms"), (1 + F.col("event_id") % 9).cast("int").alias("supply"), (1 + F.floor("value") % 9).cast("int").alias("demand"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    price = F.floor("o_totalprice").cast("long")
    return o.select(
        F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("policy"), F.col("o_orderstatus").alias("dataset"), _millis("o_orderdate").alias("started_ms"), (1 + price % 977).alias("processing_s"),
        (1 + price % 977 + F.col("o_custkey") % 100).alias("makespan_s"), (price * 10).alias("vertices"), (price * 37).alias("edges"), (F.col("o_orderkey") % 2 == 0).alias("directed"),
    )


EVENTS = f"""
    ev AS (SELECT event_id, event_type, value, 'r' || ((user_id // 5) % 6)::VARCHAR AS run, (day(ts) - 1)::INTEGER AS step, user_id % 5 AS worker, epoch_us(ts) // 1000 AS ms FROM events),
    st AS (SELECT run, step, worker, {_OP_SQL} AS op, ms AS start_ms, CASE WHEN event_id % 17 <> 0 THEN ms + round(value * 1000)::BIGINT END AS stop_ms FROM ev),
    sa AS (SELECT run, step, worker, ms AS ts_ms, event_type AS metric, value FROM ev),
    sd AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY ms, event_id)::INTEGER AS seq, step, ms AS time_ms, (1 + event_id % 9)::INTEGER AS supply, (1 + floor(value)::BIGINT % 9)::INTEGER AS demand FROM ev WHERE event_type = 'error')"""
RUNS = """
    ru AS (SELECT o_orderkey AS run, o_orderpriority AS policy, o_orderstatus AS dataset, epoch_us(o_orderdate) // 1000 AS started_ms, 1 + floor(o_totalprice)::BIGINT % 977 AS processing_s,
        1 + floor(o_totalprice)::BIGINT % 977 + o_custkey % 100 AS makespan_s, floor(o_totalprice)::BIGINT * 10 AS vertices, floor(o_totalprice)::BIGINT * 37 AS edges, o_orderkey % 2 = 0 AS directed FROM orders)"""


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"WITH {EVENTS} SELECT s.op, count(*) AS samples, round(sum(sa.value), 4) AS total FROM sa JOIN st s USING (run, step, worker) WHERE sa.ts_ms BETWEEN s.start_ms AND coalesce(s.stop_ms, 9223372036854775807) GROUP BY s.op")
def range_join_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.metrics_during(samples(spark, sf_dir), states(spark, sf_dir))
    return found.groupBy("op").agg(F.count("*").alias("samples"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT (c_custkey % 7)::BIGINT AS worker, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1")
def known_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples, customers as nodes: samples of unknown nodes fall away."""
    nodes = table(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("address"), (F.col("c_custkey") % 7).alias("worker"))
    given = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("address"))
    return m.of_known_workers(given, nodes).groupBy("worker").agg(F.count("*").alias("orders"))


_STATS = f"{EVENTS}, sw AS (SELECT run, step, worker, coalesce(stddev_samp(value), 0) AS std, avg(value) AS average, count(value) AS n FROM sa GROUP BY ALL)"


@query(f"WITH {_STATS} SELECT run, step, worker, round(std, 6) AS std, round(average, 6) AS average, n FROM sw")
def step_worker_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.step_worker_statistics(samples(spark, sf_dir)))


@query(f"WITH {_STATS} SELECT run, step, round(coalesce(stddev_samp(average), 0), 6) AS std, round(avg(average), 6) AS average, count(*) AS workers FROM sw GROUP BY run, step")
def worker_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.across_workers(m.step_worker_statistics(samples(spark, sf_dir))))


@query(f"""WITH {_STATS}, a AS (SELECT run, step, avg(average) AS average, avg(std) AS std FROM sw GROUP BY ALL), b AS (SELECT run, avg(average) AS average, avg(std) AS std FROM a GROUP BY ALL)
    SELECT 'step' AS level, run, step, round(average, 6) AS average, round(std, 6) AS std FROM a UNION ALL SELECT 'run', run, -1, round(average, 6), round(std, 6) FROM b UNION ALL SELECT 'all', '', -1, round(avg(average), 6), round(avg(std), 6) FROM b""")
def rollup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.rolled_up(m.step_worker_statistics(samples(spark, sf_dir))).na.fill({"run": "", "step": -1}))


@query(f"WITH {EVENTS} SELECT run, step, min(start_ms) AS first_start, max(stop_ms) AS last_stop, round(avg(stop_ms - start_ms), 6) AS mean_ms, sum(stop_ms - start_ms)::BIGINT AS sum_ms FROM st WHERE op = 'RUN_SUPERSTEP' AND stop_ms IS NOT NULL GROUP BY run, step")
def operation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.operation_spans(states(spark, sf_dir), "RUN_SUPERSTEP"))


@query(f"""WITH {EVENTS}, g AS (SELECT * FROM (SELECT DISTINCT run FROM st), (SELECT DISTINCT step FROM st)),
    s AS (SELECT run, step, max(stop_ms) - min(start_ms) AS span FROM st WHERE op = 'DISTRIBUTE_DATA' AND stop_ms IS NOT NULL GROUP BY ALL)
    SELECT step, round(avg(coalesce(span, 0)), 4) AS mean, round(coalesce(stddev_samp(coalesce(span, 0)), 0), 4) AS std FROM g LEFT JOIN s USING (run, step) GROUP BY step""")
def span_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.span_statistics(states(spark, sf_dir), "DISTRIBUTE_DATA"), 4)


@query(f"WITH {EVENTS} SELECT run, step, max(ts_ms) - min(ts_ms) AS wall_ms FROM sa GROUP BY run, step")
def step_wall_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.step_wall_clock(samples(spark, sf_dir))


@query(f"WITH {EVENTS}, l AS (SELECT run, max(step) AS last FROM st GROUP BY run) SELECT run, count(*) AS operations, max(step) AS last_but_one FROM st JOIN l USING (run) WHERE step < last GROUP BY run")
def earlier_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.earlier_steps(states(spark, sf_dir)).groupBy("run").agg(F.count("*").alias("operations"), F.max("step").alias("last_but_one"))


@query(f"WITH {EVENTS} SELECT run, step, sum(event_id % 100)::BIGINT AS active FROM ev GROUP BY run, step")
def active_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.active_sums(events(spark, sf_dir).select("run", "step", "worker", (F.col("event_id") % 100).alias("n")))


@query(f"WITH {_STATS}, g AS (SELECT DISTINCT run, step, w::BIGINT AS worker FROM sw, range(8) t(w)) SELECT run, step, g.worker, round(average * n, 4) AS total FROM g LEFT JOIN sw USING (run, step, worker)")
def densified_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.densified(m.step_worker_statistics(samples(spark, sf_dir)), 8), 4)


@query(f"WITH {EVENTS} SELECT step, round(avg(value), 6) AS mean, round(abs(min(value) - avg(value)), 6) AS below, round(abs(max(value) - avg(value)), 6) AS above FROM sa GROUP BY step")
def error_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.error_bars(samples(spark, sf_dir), ["step"], "value"))


_COUNTER = "c AS (SELECT run, worker, step, ms / 1000.0::DOUBLE + value AS value FROM ev WHERE event_type = 'purchase')"


@query(f"""WITH {EVENTS}, {_COUNTER}, t AS (SELECT run, worker, step, max(value) AS top FROM c GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT run, worker FROM c) JOIN (SELECT DISTINCT run, step FROM c) USING (run)),
    f AS (SELECT run, worker, step, coalesce(last_value(top IGNORE NULLS) OVER (PARTITION BY run, worker ORDER BY step ROWS UNBOUNDED PRECEDING), 0) AS counter FROM g LEFT JOIN t USING (run, worker, step))
    SELECT run, worker, step, round(counter - lag(counter, 1, 0) OVER (PARTITION BY run, worker ORDER BY step), 3) AS sent FROM f""")
def bytes_delta_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    counter = events(spark, sf_dir).filter("event_type = 'purchase'").select("run", "worker", "step", (F.col("ms") / 1000.0 + F.col("value")).alias("value"))
    return _rounded(m.bytes_by_step(counter), 3)


@query(f"WITH {EVENTS}, a AS (SELECT run, step, max(value) AS top FROM sa GROUP BY ALL) SELECT run, step, top, sign(top - lag(top) OVER (PARTITION BY run ORDER BY step))::INTEGER AS trend FROM a QUALIFY trend IS NOT NULL")
def step_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.trend(samples(spark, sf_dir).groupBy("run", "step").agg(F.max("value").alias("top")), "top").filter("trend IS NOT NULL")


@query(f"WITH {EVENTS}, s AS (SELECT run, step, avg(value) AS mean, stddev_pop(value) AS std_pop FROM sa GROUP BY ALL) SELECT run, step, worker, ts_ms, metric, value, round(mean, 6) AS mean, round(std_pop, 6) AS std_pop FROM sa JOIN s USING (run, step) WHERE value > s.mean")
def above_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.above_average(samples(spark, sf_dir), ["run", "step"]))


@query(f"WITH {EVENTS}, l AS (SELECT *, lead(time_ms) OVER (PARTITION BY run ORDER BY time_ms, seq) AS n FROM sd) SELECT run, time_ms, supply FROM l UNION ALL SELECT run, n, supply FROM l WHERE n IS NOT NULL")
def supply_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.supply_steps(supply_demand(spark, sf_dir))


@query(f"WITH {EVENTS}, l AS (SELECT *, lead(time_ms) OVER w AS n, lead(step) OVER w AS s FROM sd WINDOW w AS (PARTITION BY run ORDER BY time_ms, seq)) SELECT run, time_ms, demand FROM l UNION ALL SELECT run, n, demand FROM l WHERE n IS NOT NULL AND s <> step")
def demand_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.demand_steps(supply_demand(spark, sf_dir))


_PAIRS = f"""{EVENTS},
    pr AS (SELECT * FROM (SELECT *, lag(time_ms) OVER w AS t0, lag(supply) OVER w AS s0, lag(demand) OVER w AS d0 FROM sd WINDOW w AS (PARTITION BY run ORDER BY seq)) WHERE t0 IS NOT NULL),
    un AS (SELECT run, nullif(min(time_ms - t0), 0)::DOUBLE AS unit FROM pr GROUP BY run),
    tt AS (SELECT run, unit, (max(time_ms) - min(time_ms)) / unit AS t FROM sd JOIN un USING (run) GROUP BY run, unit)"""


@query(f"""WITH {_PAIRS} SELECT run, round(sum(greatest(0, demand - supply) * ((time_ms - t0) / unit)) / (t * 20), 9) AS u, round(sum(greatest(0, supply - demand) * ((time_ms - t0) / unit)) / (t * 20), 9) AS o,
    round(sum((greatest(0, demand - supply) // demand) * ((time_ms - t0) / unit)) / t, 9) AS un, round(sum((greatest(0, supply - demand) // demand) * ((time_ms - t0) / unit)) / t, 9) AS "on", 0.0::DOUBLE AS om FROM pr JOIN tt USING (run) GROUP BY run, t""")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = m.elasticity(supply_demand(spark, sf_dir))
    return found.select("run", *[F.round(f"accuracy_{c}", 9).alias(c) for c in ("u", "o", "un", "on", "om")])


@query(f"WITH {_PAIRS} SELECT run, round(sum((demand > supply)::INTEGER * ((time_ms - t0) / unit)) / t, 9) AS u, round(sum((supply > demand)::INTEGER * ((time_ms - t0) / unit)) / t, 9) AS o FROM pr JOIN tt USING (run) GROUP BY run, t")
def wrong_provisioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.elasticity(supply_demand(spark, sf_dir)).select("run", F.round("wrong_u", 9).alias("u"), F.round("wrong_o", 9).alias("o"))


@query(f"WITH {_PAIRS} SELECT run, round(sum(least(1, greatest(0, sign(supply - s0) - sign(demand - d0))) * ((time_ms - t0) / unit)) / (t - 1), 9) AS i, round(sum(least(1, greatest(0, sign(demand - d0) - sign(supply - s0))) * ((time_ms - t0) / unit)) / (t - 1), 9) AS i2 FROM pr JOIN tt USING (run) GROUP BY run, t")
def instability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.elasticity(supply_demand(spark, sf_dir)).select("run", F.round("instability_i", 9).alias("i"), F.round("instability_i2", 9).alias("i2"))


@query(f"""WITH {EVENTS}, ch AS (SELECT run, step, supply, demand FROM (SELECT *, row_number() OVER (PARTITION BY run, step ORDER BY seq DESC) AS k FROM sd WHERE supply <> demand) WHERE k = 1),
    w AS (SELECT run, step, worker, sum(stop_ms - start_ms)::BIGINT AS ms FROM st WHERE op = 'DISTRIBUTE_DATA' AND stop_ms IS NOT NULL GROUP BY ALL), s AS (SELECT run, step, max(ms) AS longest, sum(ms)::BIGINT AS total FROM w GROUP BY ALL)
    SELECT run, sum(coalesce(longest, 0))::BIGINT AS elastic_ms, sum(CASE WHEN demand > supply THEN coalesce(total, 0) // supply * demand ELSE coalesce(total, 0) END)::BIGINT AS machine_ms FROM ch LEFT JOIN s USING (run, step) GROUP BY run""")
def elastic_overheads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.elastic_overheads(states(spark, sf_dir), supply_demand(spark, sf_dir))


@query(f"WITH {EVENTS} SELECT DISTINCT run, 0.0::DOUBLE AS u, 0.0::DOUBLE AS o, 0.0::DOUBLE AS i, 0.0::DOUBLE AS i2 FROM st")
def baseline_elasticity(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = states(spark, sf_dir).select("run", "step").distinct()
    found = m.elasticity(m.baseline_supply(steps, 10))
    return found.select("run", F.col("accuracy_u").alias("u"), F.col("accuracy_o").alias("o"), F.col("instability_i").alias("i"), F.col("instability_i2").alias("i2"))


@query(f"WITH {RUNS} SELECT run, vertices // processing_s AS vps, (CASE WHEN directed THEN edges ELSE 2 * edges END) // processing_s AS eps FROM ru")
def throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.throughput(runs(spark, sf_dir)).select("run", "vps", "eps")


_MEANS = f"{RUNS}, tp AS (SELECT *, vertices // processing_s AS vps, (CASE WHEN directed THEN edges ELSE 2 * edges END) // processing_s AS eps FROM ru), av AS (SELECT policy, count(*) AS n, (sum(makespan_s) // count(*))::BIGINT AS makespan_s, (sum(processing_s) // count(*))::BIGINT AS processing_s, (sum(vps) // count(*))::BIGINT AS vps, (sum(eps) // count(*))::BIGINT AS eps, min(processing_s) AS lo, max(processing_s) AS hi FROM tp GROUP BY policy)"


def _means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.performance_means(m.throughput(runs(spark, sf_dir)), "policy", ["makespan_s", "processing_s", "vps", "eps"])


@query(f"WITH {_MEANS} SELECT * FROM av")
def performance_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _means(spark, sf_dir).select("policy", "n", "makespan_s", "processing_s", "vps", "eps", F.col("processing_s_min").alias("lo"), F.col("processing_s_max").alias("hi"))


@query(f"WITH {RUNS}, a AS (SELECT dataset, count(*) AS n, (sum(processing_s) // count(*))::BIGINT AS mean FROM ru GROUP BY dataset) SELECT dataset, a.n, a.mean, round(sqrt(sum(pow(processing_s - mean, 2)) / (a.n - 1)) / mean, 9) AS cv FROM ru JOIN a USING (dataset) GROUP BY dataset, a.n, a.mean")
def cv_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(m.variation(runs(spark, sf_dir), "dataset", "processing_s"), 9)


@query(f"WITH {RUNS} SELECT policy, run, place FROM (SELECT policy, run, row_number() OVER (PARTITION BY policy ORDER BY started_ms DESC, run DESC)::INTEGER AS place FROM ru) WHERE place <= 3")
def newest3_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.newest(runs(spark, sf_dir), "policy", "started_ms").select("policy", "run", "place")


_LESS = "(CASE WHEN a.{0} < b.{0} THEN 1.0 WHEN a.{0} = b.{0} THEN 0.5 ELSE 0 END)"
_MORE = "(CASE WHEN a.{0} > b.{0} THEN 1.0 WHEN a.{0} = b.{0} THEN 0.5 ELSE 0 END)"


@query(f"WITH {_MEANS}, s AS (SELECT *, vps + eps AS both_ps FROM av) SELECT a.policy, sum({_LESS.format('makespan_s')} + {_LESS.format('processing_s')} + {_MORE.format('vps')} + {_MORE.format('both_ps')})::DOUBLE AS score FROM s a, s b GROUP BY a.policy")
def tournament_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.tournament(_means(spark, sf_dir), "policy", ["makespan_s", "processing_s"], ["vps", F.col("vps") + F.col("eps")])


_ELASTIC = ("accuracy_u", "accuracy_o", "accuracy_un", "accuracy_on", "accuracy_om", "instability_i", "instability_i2", "wrong_u", "wrong_o")
_TOURNEY = f"""{_PAIRS}, el AS (SELECT run, round(sum(greatest(0, demand - supply) * ((time_ms - t0) / unit)) / (t * 20), 9) AS accuracy_u, round(sum(greatest(0, supply - demand) * ((time_ms - t0) / unit)) / (t * 20), 9) AS accuracy_o,
    round(sum((greatest(0, demand - supply) // demand) * ((time_ms - t0) / unit)) / t, 9) AS accuracy_un, round(sum((greatest(0, supply - demand) // demand) * ((time_ms - t0) / unit)) / t, 9) AS accuracy_on, 0 AS accuracy_om,
    round(sum(least(1, greatest(0, sign(supply - s0) - sign(demand - d0))) * ((time_ms - t0) / unit)) / (t - 1), 9) AS instability_i, round(sum(least(1, greatest(0, sign(demand - d0) - sign(supply - s0))) * ((time_ms - t0) / unit)) / (t - 1), 9) AS instability_i2,
    round(sum((demand > supply)::INTEGER * ((time_ms - t0) / unit)) / t, 9) AS wrong_u, round(sum((supply > demand)::INTEGER * ((time_ms - t0) / unit)) / t, 9) AS wrong_o FROM pr JOIN tt USING (run) GROUP BY run, t)"""


@query(f"WITH {_TOURNEY} SELECT a.run, sum({' + '.join(_LESS.format(c) for c in _ELASTIC)})::DOUBLE AS score FROM el a, el b GROUP BY a.run")
def tournament(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run is a policy of one run."""
    return m.tournament(_rounded(m.elasticity(supply_demand(spark, sf_dir)), 9), "run", list(_ELASTIC))


@query(f"WITH {_MEANS}, s AS (SELECT *, vps + eps AS both_ps FROM av), p AS (SELECT a.policy, sum({_LESS.format('makespan_s')}) AS x, sum({_MORE.format('vps')} + {_MORE.format('both_ps')}) AS y FROM s a, s b GROUP BY a.policy) SELECT policy, (x + y)::DOUBLE AS score FROM p")
def tournament_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = _means(spark, sf_dir)
    return m.combined_scores(m.tournament(means, "policy", ["makespan_s"]), m.tournament(means, "policy", [], ["vps", F.col("vps") + F.col("eps")]), "policy")


# The whole tournaments of the reference, on runs that have states as well as supply and demand; three policies of two runs each.

_WHOLE = f"""{_TOURNEY},
    re AS (SELECT run, (max(greatest(start_ms, coalesce(stop_ms, start_ms))) - min(start_ms)) // 1000 AS makespan_s FROM st GROUP BY run),
    sp AS (SELECT run, step, max(stop_ms) - min(start_ms) AS span, sum(stop_ms - start_ms)::BIGINT AS ms FROM st WHERE op = 'RUN_SUPERSTEP' AND stop_ms IS NOT NULL GROUP BY ALL),
    pt AS (SELECT run, 1 + sum(span)::BIGINT // 1000 AS processing_s, sum(ms)::BIGINT // 1000 AS superstep_s FROM sp GROUP BY run),
    vc AS (SELECT run, sum(event_id % 100)::BIGINT * 1000 AS vertices, sum(event_id % 1000)::BIGINT * (CASE WHEN substr(run, 2)::INTEGER % 2 = 0 THEN 1000 ELSE 2000 END) AS edges FROM ev GROUP BY run),
    mt AS (SELECT run, sum(ms)::BIGINT // 1000 AS machine_s FROM (SELECT run, worker, max(greatest(start_ms, coalesce(stop_ms, start_ms))) - min(start_ms) AS ms FROM st GROUP BY ALL) GROUP BY run),
    ch AS (SELECT run, step, supply, demand FROM (SELECT *, row_number() OVER (PARTITION BY run, step ORDER BY seq DESC) AS k FROM sd WHERE supply <> demand) WHERE k = 1),
    dt AS (SELECT run, step, sum(stop_ms - start_ms)::BIGINT AS total FROM st WHERE op = 'DISTRIBUTE_DATA' AND stop_ms IS NOT NULL GROUP BY ALL),
    eo AS (SELECT run, sum(CASE WHEN demand > supply THEN coalesce(total, 0) // supply * demand ELSE coalesce(total, 0) END)::BIGINT // 1000 AS elastic_overhead_s FROM ch LEFT JOIN dt USING (run, step) GROUP BY run),
    pr7 AS (SELECT 'p' || (substr(run, 2)::INTEGER % 3)::VARCHAR AS policy, run, makespan_s, coalesce(processing_s, 1) AS processing_s, coalesce(superstep_s, 0) AS superstep_s, machine_s, coalesce(elastic_overhead_s, 0) AS elastic_overhead_s, vertices // coalesce(processing_s, 1) AS vps, edges // coalesce(processing_s, 1) AS eps
        FROM re JOIN vc USING (run) JOIN mt USING (run) LEFT JOIN pt USING (run) LEFT JOIN eo USING (run)),
    pm AS (SELECT policy, {', '.join(f'(sum({c}) // count(*))::BIGINT AS {c}' for c in (*m.PERFORMANCE, 'vps', 'eps'))} FROM pr7 GROUP BY policy),
    pq AS (SELECT *, vps + eps AS both_ps FROM pm),
    ps AS (SELECT a.policy, sum({' + '.join(_LESS.format(c) for c in m.PERFORMANCE)} + {_MORE.format('vps')} + {_MORE.format('both_ps')})::DOUBLE AS score FROM pq a, pq b GROUP BY a.policy),
    em AS (SELECT 'p' || (substr(run, 2)::INTEGER % 3)::VARCHAR AS policy, {', '.join(f'round(avg({c}), 9) AS {c}' for c in m.ELASTICITY)} FROM el GROUP BY 1),
    es AS (SELECT a.policy, sum({' + '.join(_LESS.format(c) for c in m.ELASTICITY)})::DOUBLE AS score FROM em a, em b GROUP BY a.policy)"""


def _policy() -> Column:
    return F.concat(F.lit("p"), (F.substring("run", 2, 9).cast("int") % 3).cast("string")).alias("policy")


def _whole_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    st = states(spark, sf_dir)
    last = F.greatest(F.max("start_ms"), F.max("stop_ms"))
    spans = m.operation_spans(st, "RUN_SUPERSTEP").groupBy("run").agg(F.sum(F.col("last_stop") - F.col("first_start")).alias("ms"))
    sizes = events(spark, sf_dir).groupBy("run").agg((F.sum(F.col("event_id") % 100) * 1000).alias("vertices"), (F.sum(F.col("event_id") % 1000) * 1000).alias("edges"))
    given = st.groupBy("run").agg((last - F.min("start_ms")).alias("all_ms")).join(spans, "run", "left").join(sizes, "run").select(
        "run", _policy(), "vertices", "edges", (F.substring("run", 2, 9).cast("int") % 2 == 0).alias("directed"),
        F.expr("all_ms div 1000").alias("makespan_s"), F.expr("1 + coalesce(ms, 0) div 1000").alias("processing_s"),
    )
    measured = m.throughput(given).join(m.run_times(st, supply_demand(spark, sf_dir)), "run")
    return m.performance_tournament(m.performance_means(measured, "policy", [*m.PERFORMANCE, "vps", "eps"]), "policy")


@query(f"WITH {_WHOLE} SELECT policy, score FROM ps")
def tournament_performance_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All seven comparisons."""
    return _whole_performance(spark, sf_dir)


@query(f"WITH {_WHOLE} SELECT policy, ps.score + es.score AS score FROM ps JOIN es USING (policy)")
def tournament_combined_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of elasticity and of performance, each of its whole tournament."""
    each = _rounded(m.elasticity(supply_demand(spark, sf_dir)), 9)
    return m.combined_scores(_whole_performance(spark, sf_dir), m.elastic_tournament(m.elastic_means(each, _policy()), "policy"), "policy")


@query(f"WITH {RUNS}, x AS (SELECT dataset, policy, max_by(run, started_ms * 1000000 + run) AS newest, min_by(run, started_ms * 1000000 + run) AS oldest FROM ru GROUP BY ALL) SELECT * FROM x")
def first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last run of each dataset and policy by starting time."""
    at = F.struct("started_ms", "run")
    return runs(spark, sf_dir).groupBy("dataset", "policy").agg(F.max_by("run", at).alias("newest"), F.min_by("run", at).alias("oldest"))
