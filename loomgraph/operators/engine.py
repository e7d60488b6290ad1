"""Supersteps as DataFrame plans, and the loop that runs them.

A superstep joins the state with the inbox, projects the new state, joins the
computed vertices with the edges they send along, and groups what they send by
target, which Spark combines before the shuffle.  Each step's state and inbox
are written to files, so a long run neither grows its plan nor loses its past with
an executor; those of the step before are then deleted.

State, inbox and edges are hash-partitioned by vertex into the same number of
buckets, so the messages' shuffle is the only one
of a step: neither state nor edges move.  Adaptive execution would forget the
partitioning of what it has run and shuffle both again in every step, so it is
off inside the loop.  What it would do about skew is done when edges are laid
out: vertices with more edges than a fair share of a partition, which can't be
many, have them spread by salt.  Votes, counts and aggregators are observed
while the files are written, without a job of their own.
"""

from __future__ import annotations

import itertools
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, CalendarIntervalType, DataType, MapType, NullType, StructType

from ..graph import Graph, undirected
from ..sources.shared import shared_folder
from .program import COMBINERS, Aggregator, Along, Combine, Context, PandasStep, PregelStep, QueryStep, Send, VertexProgram


@dataclass
class Result:
    """``state`` has ``id, value, halted``; ``history`` a record for each superstep; ``edges`` what they became."""

    state: DataFrame
    aggregated: dict[str, object]
    history: list[dict]
    edges: DataFrame
    seconds: float = 0.0

    def values(self, name: str = "value") -> DataFrame:
        return self.state.select("id", F.col("value").alias(name))


def _folder(spark: SparkSession) -> str:
    """Where states, inboxes and edges are written."""
    use_shared_checkpoints(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def use_shared_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the folder that ``spark.checkpoint.dir`` names; a local session may do without the setting."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    context.setCheckpointDir(shared_folder(spark))


def active(halted: str = "halted", has_msg: str = "has_msg") -> Column:
    """A vertex is computed if it hasn't halted or has a message."""
    return ~F.col(halted) | F.col(has_msg)


def with_inbox(state: DataFrame, inbox: DataFrame | None) -> DataFrame:
    """State with ``msg`` and ``has_msg``; messages to ids that don't exist fall away here."""
    if inbox is None:
        return state.withColumn("msg", F.lit(None)).withColumn("has_msg", F.lit(False))
    found = inbox.select(F.col("dst").alias("_dst"), "msg", F.lit(True).alias("_has"))
    return state.join(found, F.col("id") == F.col("_dst"), "left").withColumn("has_msg", F.coalesce("_has", F.lit(False))).drop("_dst", "_has")


def computed(joined: DataFrame, value: Column | None, halt: Column) -> DataFrame:
    """The state after a step, still with what messages may use; vertices that aren't computed pass through."""
    now = active()
    kind = joined.schema["value"].dataType
    new = F.col("value") if value is None else F.when(now, value.cast(kind)).otherwise(F.col("value"))
    return joined.select(*[c for c in joined.columns if c not in ("value", "halted")], now.alias("active"), F.col("value").alias("old_value"), new.alias("value"), F.when(now, halt).otherwise(F.col("halted")).alias("halted"))


class Edges:
    """Edges laid out for joins with their sources, out of them and both ways."""

    def __init__(self, edges: DataFrame, partitions: int | None = None):
        self.plain, self.partitions = edges, partitions
        self._ways: dict[Along, tuple[DataFrame, DataFrame | None]] = {}

    def along(self, way: Along) -> tuple[DataFrame, DataFrame | None]:
        """The edges, with a salt where some vertex has very many, and then those vertices with their numbers of salts."""
        if way not in self._ways:
            self._ways[way] = self._laid_out(self.plain if way is Along.OUT_EDGES else undirected(self.plain))
        return self._ways[way]

    def _laid_out(self, edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        n = self.partitions
        if n is None:
            return edges, None
        degrees = edges.groupBy("src").agg(F.count("*").alias("k"))
        total = degrees.agg(F.sum("k")).first()[0] or 0
        share = max(10_000, total // n)
        hubs = [(r.src, -(-r.k // share)) for r in degrees.filter(F.col("k") > 2 * share).collect()]  # fewer than n / 2
        if not hubs:
            return _kept(edges.repartition(n, "src"), ("src",), n, ordered=True), None
        spread = edges.sparkSession.createDataFrame(hubs, f"_hub {edges.schema['src'].dataType.simpleString()}, _salts int")
        salted = edges.join(F.broadcast(spread), F.col("src") == F.col("_hub"), "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64("dst"), "_salts"), F.lit(0)).cast("int"))
        return _kept(salted.drop("_hub", "_salts").repartition(n, "src", "_salt"), ("src", "_salt"), n, ordered=True), spread


def outbox(done: DataFrame, edges: Edges | DataFrame | None, sends: tuple[Send, ...]) -> DataFrame | None:
    """All messages ``dst, msg`` that the computed vertices send."""
    out = None
    edges = Edges(edges) if isinstance(edges, DataFrame) else edges
    for send in sends:
        who = done.filter(F.col("active") if send.when is None else F.col("active") & send.when)
        if isinstance(send.to, Along):
            ways, spread = edges.along(send.to)
            if spread is None:
                both = who.join(ways, F.col("id") == F.col("src"))
            else:
                who = who.join(F.broadcast(spread), F.col("id") == F.col("_hub"), "left")
                who = who.withColumn("_place", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
                both = who.join(ways, (F.col("id") == F.col("src")) & (F.col("_place") == F.col("_salt")))
            some = both.select("dst", send.message.alias("msg"))
        else:
            to = who.select(send.to.alias("_to"), send.message.alias("msg"))
            array = to.schema["_to"].dataType.typeName() == "array"
            some = to.select(F.explode("_to").alias("dst") if array else F.col("_to").alias("dst"), "msg")
        out = some if out is None else out.unionByName(some)
    return out


def combine(messages: DataFrame, how: str | Combine) -> DataFrame:
    return (COMBINERS[how] if isinstance(how, str) else how)(messages)


def _changed_edges(edges: DataFrame, done: DataFrame, step: PregelStep) -> DataFrame:
    own = done.filter("active").select("id", "value", "old_value", F.lit(True).alias("_own"))
    if step.edge_value is not None or step.edge_target is not None:
        both = edges.join(own, F.col("src") == F.col("id"), "left")
        mine = F.col("_own").isNotNull()
        columns = ["src", F.when(mine, step.edge_target).otherwise(F.col("dst")).alias("dst") if step.edge_target is not None else "dst"]
        if "e" in edges.columns:
            columns.append(F.when(mine, step.edge_value).otherwise(F.col("e")).alias("e") if step.edge_value is not None else "e")
        edges = both.select(*columns)
    for target, value, when in step.add_edges:
        who = done.filter(F.col("active") if when is None else F.col("active") & when)
        new = [F.col("id").alias("src"), target.alias("dst")]
        if "e" in edges.columns:
            new.append((F.lit(None) if value is None else value).cast(edges.schema["e"].dataType).alias("e"))
        edges = edges.unionByName(who.select(*new))
    return edges


def ask(joined: DataFrame, edges: DataFrame, step: QueryStep, partitions: int, past: list[DataFrame]) -> DataFrame:
    """The state after a query-answer-process step: ``msg`` holds the gathered answers at ``process``.

    The frame of what the queries wrote goes to ``past``, for the caller to delete.

    Answers see the values that all queries wrote, and none that processing writes.
    Vertices that are asked more often than twice a partition's fair share are
    joined by broadcast.
    """
    now = active()
    kind = joined.schema["value"].dataType
    asked = joined.withColumn("active", now).withColumn("old_value", F.col("value"))
    if step.query_value is not None:
        asked = asked.withColumn("value", F.when(now, step.query_value.cast(kind)).otherwise(F.col("value")))
    asked, seen = _observed(asked, {"queries": F.sum(F.when(F.col("active"), F.size(step.queries)))}, ("id",), partitions)
    past.append(asked)
    queries = asked.filter("active").select(F.col("id").alias("src"), F.explode(step.queries).alias("_q")).select("src", F.col("_q.dst").alias("dst"), F.col("_q.s").alias("s"))
    target = asked.select(F.col("id").alias("_target"), "value")
    if step.reads_edges:
        adjacent = edges.groupBy(F.col("src").alias("_from")).agg(F.collect_list("dst").alias("out"))
        target = target.join(adjacent, F.col("_target") == F.col("_from"), "left").drop("_from")
    share = max(10_000, (seen["queries"] or 0) // partitions)
    hubs = queries.groupBy("dst").agg(F.count("*").alias("k")).filter(F.col("k") > 2 * share).collect() if (seen["queries"] or 0) > 2 * share else []
    if hubs:  # fewer than n / 2
        often = F.broadcast(queries.sparkSession.createDataFrame([(r.dst,) for r in hubs], f"_hub {queries.schema['dst'].dataType.simpleString()}"))
        hot = target.join(often, F.col("_target") == F.col("_hub"), "left_semi")
        queries = queries.join(often, F.col("dst") == F.col("_hub"), "left")
        same = F.col("dst") == F.col("_target")
        met = queries.filter("_hub IS NULL").join(target, same, "left").unionByName(queries.filter("_hub IS NOT NULL").join(F.broadcast(hot), same, "left"))
    else:
        met = queries.join(target, F.col("dst") == F.col("_target"), "left")
    answers = met.select("src", step.answer.alias("answer"))
    gathered = answers.groupBy("src").agg(step.gather(F.col("answer")).alias("_answers"))
    back = asked.drop("msg").join(gathered, F.col("id") == F.col("src"), "left").withColumnRenamed("_answers", "msg").drop("src")
    new = F.col("value") if step.process is None else F.when(F.col("active"), step.process.cast(kind)).otherwise(F.col("value"))
    rest = [c for c in back.columns if c not in ("value", "halted")]
    return back.select(*rest, new.alias("value"), F.when(F.col("active"), step.halt).otherwise(F.col("halted")).alias("halted"))


def _pandas(joined: DataFrame, edges: DataFrame, step: PandasStep, context: Context) -> DataFrame:
    """The state after a step in pandas, with its messages in the array column ``_sent``."""
    import pandas as pd

    id_type = joined.schema["id"].dataType.simpleString()
    rest = [c for c in joined.columns if c not in ("id", "value", "halted", "msg", "has_msg")]
    kinds = ", ".join(f"{c} {joined.schema[c].dataType.simpleString()}" for c in rest)
    schema = f"id {id_type}, {kinds + ', ' if kinds else ''}active boolean, old_value {step.value_type}, value {step.value_type}, halted boolean, has_msg boolean, _sent array<struct<dst: {id_type}, msg: {step.message_type}>>"
    names = [x.split()[0] for x in schema.split(", ")][: 6 + len(rest)]
    with_e = "e" in edges.columns
    compute = step.compute

    def one(key: tuple, state: pd.DataFrame, out: pd.DataFrame) -> pd.DataFrame:
        if not len(state):
            return pd.DataFrame({c: [] for c in [*names, "_sent"]})
        row = state.iloc[0]
        run = bool(row.has_msg) or not bool(row.halted)
        value, halted, sent = row.value, bool(row.halted), []
        if run:
            got = row.msg if row.has_msg else []
            messages = list(got) if isinstance(got, (list, tuple)) or hasattr(got, "tolist") else [got]
            value, halted, sent = compute(row.value, messages, list(zip(out.dst, out.e if with_e else [None] * len(out), strict=True)), context)
        return pd.DataFrame([{"id": row.id, **{c: row[c] for c in rest}, "active": run, "old_value": row.value, "value": value, "halted": bool(halted), "has_msg": bool(row.has_msg), "_sent": [{"dst": d, "msg": m} for d, m in sent]}])

    if joined.schema["msg"].dataType.typeName() == "void":
        joined = joined.withColumn("msg", F.lit(None).cast(f"array<{step.message_type}>"))
    return joined.groupBy("id").cogroup(edges.withColumnRenamed("src", "id").groupBy("id")).applyInPandas(one, schema)


#: What holds inside the loop: a task reads one bucket, and writes it without a sort.
_SETTINGS = {
    "spark.sql.adaptive.enabled": "false",
    "spark.sql.sources.bucketing.enabled": "true",
    "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false",
    "spark.sql.legacy.bucketedTableScan.outputOrdering": "true",
    "spark.sql.optimizer.plannedWrite.enabled": "false",
    "spark.sql.maxConcurrentOutputFileWriters": "4",
}


def run(graph: Graph, program: VertexProgram, params: dict | None = None, max_steps: int | None = None, partitions: int | None = None) -> Result:
    """Runs the program until every computed vertex votes to halt and nothing has been sent.

    There is no limit of steps unless ``max_steps`` is given; a run that isn't
    done by then fails, as its state isn't a result.  Messages to ids that don't
    exist keep the run going for one more step, and are then dropped.
    """
    spark = graph.vertices.sparkSession
    use_shared_checkpoints(spark)
    params = params or {}
    program.load(params)
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        return _loop(graph, program, params, max_steps, partitions or int(spark.conf.get("spark.sql.shuffle.partitions")))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _storable(kind: DataType) -> bool:
    """Whether Parquet files hold the type."""
    if isinstance(kind, StructType):
        return all(_storable(f.dataType) for f in kind.fields)
    if isinstance(kind, ArrayType):
        return _storable(kind.elementType)
    if isinstance(kind, MapType):
        return _storable(kind.keyType) and _storable(kind.valueType)
    return not isinstance(kind, (NullType, CalendarIntervalType))


def _observed(df: DataFrame, facts: dict[str, Column], keys: tuple[str, ...] = (), n: int = 0, ordered: bool = False) -> tuple[DataFrame, dict]:
    """``df`` written to files and read back, and aggregates of its rows that are taken on the way.

    With ``keys`` it lies in ``n`` buckets by them, which joins and groups by them
    read without a shuffle, and, if ``ordered``, without a sort.
    """
    seen, spark = Observation(), df.sparkSession
    voids = [f.name for f in df.schema.fields if isinstance(f.dataType, NullType)]
    columns = df.columns
    df = df.drop(*voids)
    if not _storable(df.schema):
        return _checkpointed(df, facts, seen, voids, columns)
    path, name = f"{_folder(spark)}/superstep-{uuid.uuid4().hex}", f"spark_catalog.default.superstep_{uuid.uuid4().hex}"
    writer = df.observe(seen, *[c.alias(k) for k, c in facts.items()]).write.format("parquet").option("path", path)
    if keys:
        writer = writer.bucketBy(n, *keys)
        if ordered:
            writer = writer.sortBy(*keys)
    writer.saveAsTable(name)
    kept = spark.table(name)
    kept.schema  # read from the catalogue before the table is taken out of it; its files stay
    spark.sql(f"DROP TABLE {name}")
    kept = _with_voids(kept, voids, columns)
    kept._written_to = path
    return kept, seen.get


def _checkpointed(df: DataFrame, facts: dict[str, Column], seen: Observation, voids: list[str], columns: list[str]) -> tuple[DataFrame, dict]:
    """As ``_observed``, for types that files don't hold.

    It is cached while the checkpoint is written, for the sake of its size: a
    plain checkpoint keeps the estimate of its plan, where a join counts as the
    product of its sides, and from step to step that grows without end.
    """
    cached = df.persist()
    try:
        kept = cached.observe(seen, *[c.alias(k) for k, c in facts.items()]).checkpoint()
    finally:
        cached.unpersist()
    file = kept._jdf.queryExecution().logical().rdd().getCheckpointFile()
    kept = _with_voids(kept, voids, columns)
    kept._written_to = file.get() if file.isDefined() else None
    return kept, seen.get


def _with_voids(df: DataFrame, voids: list[str], columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.lit(None) for c in voids}).select(*columns) if voids else df


def _forget(frames: list[DataFrame]) -> None:
    """Deletes the files of frames that nothing needs any more."""
    for df in frames:
        if df._written_to:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    frames.clear()


def _kept(df: DataFrame, keys: tuple[str, ...] = (), n: int = 0, ordered: bool = False) -> DataFrame:
    return _observed(df, {"rows": F.count(F.lit(1))}, keys, n, ordered)[0]


def _loop(graph: Graph, program: VertexProgram, params: dict, max_steps: int | None, n: int) -> Result:
    count = {"rows": F.count(F.lit(1))}
    plain, edge_facts = _observed(graph.edges, count)
    edges = Edges(plain, n)
    ids, vertex_facts = _observed(graph.vertices.select("id").repartition(n, "id"), count, ("id",), n)
    sizes = (vertex_facts["rows"], edge_facts["rows"])
    aggregated = {k: a.initial for k, a in program.aggregators.items()}
    context = Context(0, *sizes, aggregated, params)
    state = ids
    if (own := program.vertex_columns(graph)) is not None:
        state = state.join(own, "id", "left")
    constant = [c for c in state.columns if c != "id"]
    # As the element of an array: a plain copy of the id would take over the partitioning's name, which joins by id look for.
    first = F.element_at(F.array(program.initial(context)), 1)
    state = _kept(state.withColumn("value", first).withColumn("halted", F.lit(False)).repartition(n, "id"), ("id",), n)
    inbox: DataFrame | None = None
    old: list[DataFrame] = [state]
    history: list[dict] = []
    began = time.monotonic()
    for number in itertools.count():
        if number == max_steps:
            raise RuntimeError(f"{type(program).__name__} isn't done after {max_steps} supersteps")
        started = time.monotonic()
        context = Context(number, *sizes, dict(aggregated), params)
        program.before_step(context)
        step = program.step(context)
        joined = with_inbox(state, inbox)
        messages = None
        aggregate: dict[str, Column] = {}
        if isinstance(step, PandasStep):
            done = _pandas(joined, edges.plain, step, context)
        elif isinstance(step, QueryStep):
            done, aggregate = ask(joined, edges.plain, step, n, old), step.aggregate
        else:
            done, aggregate = computed(joined, step.value, step.halt), step.aggregate
        # Halting votes, counts and aggregators while the state is written.
        facts = {"computed": F.count_if("active"), "all": F.coalesce(F.bool_and(F.when(F.col("active"), F.col("halted"))), F.lit(True)), "awake": F.count_if(~F.col("halted"))}
        facts |= {f"agg_{k}": program.aggregators[k].how(F.when(F.col("active"), c)) for k, c in aggregate.items()}
        done, row = _observed(done, facts, ("id",), n)
        if isinstance(step, PandasStep):
            messages = done.filter("active").select(F.explode("_sent").alias("_m")).select("_m.dst", "_m.msg")
        elif isinstance(step, PregelStep):
            messages = outbox(done, edges, step.sends)
        inbox, sent = None, 0
        if messages is not None:
            inbox, seen = _observed(combine(messages, step.combine), count, ("dst",), n)
            sent = seen["rows"]  # before unknown targets are dropped
        _forget(old)
        old = [x for x in (done, inbox) if x is not None]
        if isinstance(step, PregelStep) and (step.edge_value is not None or step.edge_target is not None or step.add_edges):
            edges = Edges(_kept(_changed_edges(edges.plain, done, step)), n)
        for name, a in program.aggregators.items():
            aggregated[name] = _next(a, aggregated[name], row.get(f"agg_{name}"))
        state = done.select("id", *constant, "value", "halted")
        record = {"step": number, "computed": row["computed"], "not_halted": row["awake"], "targets": sent, "seconds": time.monotonic() - started, "aggregated": dict(aggregated)}
        history.append(record)
        program.after_step(context, record)
        if row["all"] and not sent:
            break
        inbox = inbox if sent else None
    _forget(old[1:])
    return Result(state, aggregated, history, edges.plain, time.monotonic() - began)


def _next(a: Aggregator, before: object, now: object) -> object:
    if now is None:
        return before if a.persistent else a.initial
    return a.merge(before, now) if a.persistent and before is not None else now


def active_by_step(spark: SparkSession, history: list[dict]) -> DataFrame:
    """``step, computed, targets`` of a run: one small row for each step."""
    rows = [(r["step"], r["computed"], r["targets"]) for r in history]
    return spark.createDataFrame(rows, "step int, computed long, targets long")
