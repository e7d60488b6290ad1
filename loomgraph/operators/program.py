"""What a vertex program says: column expressions for each superstep.

Expressions of a step may use these columns: ``id``, ``value``, ``halted``,
``msg`` (the combined inbox, or an array of messages without a combiner),
``has_msg`` and the program's own vertex columns.  Messages and edge changes
see the value after the step as ``value``, the one before it as
``old_value``, and, along edges, ``dst`` and ``e``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Along(Enum):
    """Targets of a message that follow edges."""

    OUT_EDGES = "out"
    BOTH_WAYS = "both"


@dataclass(frozen=True)
class Send:
    """A message to the ends of edges, or to an id (or an array of ids) whether or not an edge leads there."""

    to: Along | Column
    message: Column
    when: Column | None = None


Combine = Callable[[DataFrame], DataFrame]


def combined(how: Callable[[Column], Column]) -> Combine:
    """One message for each target by an aggregate that Spark can apply before the shuffle as well."""
    return lambda outbox: outbox.groupBy("dst").agg(how(F.col("msg")).alias("msg"))


def most_frequent(outbox: DataFrame) -> DataFrame:
    """The message that occurs most often, the smallest of several."""
    counts = outbox.groupBy("dst", "msg").agg(F.count("*").alias("n"))
    return counts.groupBy("dst").agg(F.min_by("msg", F.struct((-F.col("n")).alias("n"), "msg")).alias("msg"))


COMBINERS: dict[str, Combine] = {
    "sum": combined(F.sum),
    "min": combined(F.min),
    "max": combined(F.max),
    "count": combined(lambda m: F.count(F.lit(1))),
    "collect": combined(F.collect_list),
    "mode": most_frequent,
}


@dataclass(frozen=True)
class PregelStep:
    """``halt``: true votes to halt.  Without ``value`` the value stays."""

    halt: Column
    value: Column | None = None
    sends: tuple[Send, ...] = ()
    combine: str | Combine = "collect"
    #: Contributions of computed vertices to the program's aggregators.
    aggregate: dict[str, Column] = field(default_factory=dict)
    #: New edge value (and target) of computed vertices' out-edges, from ``value, dst, e``; applied when the step ends.
    edge_value: Column | None = None
    edge_target: Column | None = None
    #: New out-edges of computed vertices: (target, edge value or None, condition or None). Targets aren't created.
    add_edges: tuple[tuple[Column, Column | None, Column | None], ...] = ()


@dataclass(frozen=True)
class QueryStep:
    """Query, answer and process within one superstep.

    ``queries`` is an array of ``struct(dst, s)`` that each computed vertex
    asks; ``query_value`` is written before any answer is given.  ``answer``
    may use the asked vertex's ``value`` (null if there is none), ``s``,
    ``src``, and its ``out`` (an array of its edges' targets) if ``reads_edges``;
    it changes nothing.  ``gather`` folds a vertex's answers, the column
    ``answer``, into ``msg``; by default an array.  ``process`` and ``halt``
    are then evaluated at the asking vertex, without queries too.
    """

    queries: Column
    answer: Column
    halt: Column
    process: Column | None = None
    query_value: Column | None = None
    gather: Callable[[Column], Column] = F.collect_list
    reads_edges: bool = False
    aggregate: dict[str, Column] = field(default_factory=dict)


@dataclass(frozen=True)
class PandasStep:
    """A step that columns can't express.

    ``compute(value, messages, out_edges, context)`` gets a vertex's value, the
    list of its messages and a list of (target, edge value), and returns (value,
    vote to halt, list of (target, message)).  One vertex's messages and edges
    are in memory at a time, together with an Arrow batch of others.
    """

    compute: Callable
    value_type: str
    message_type: str
    combine: str | Combine = "collect"


Step = PregelStep | QueryStep | PandasStep


@dataclass(frozen=True)
class Aggregator:
    """A value over all computed vertices, readable in the next step.

    By default each step starts anew; a ``persistent`` one folds the value
    before it in once, by ``merge``.
    """

    how: Callable[[Column], Column]
    initial: object = None
    persistent: bool = False
    merge: Callable[[object, object], object] = lambda before, now: now


@dataclass(frozen=True)
class Context:
    """What is known when a step is planned."""

    step: int
    num_vertices: int
    num_edges: int
    aggregated: dict[str, object]
    params: dict


class VertexProgram:
    """Subclasses say what a vertex starts with and what it does in each superstep."""

    #: Aggregators by name.
    aggregators: dict[str, Aggregator] = {}

    def load(self, params: dict) -> None:
        """Reads parameters before the run."""

    def vertex_columns(self, graph) -> DataFrame | None:
        """``id`` and constant columns that steps may use."""
        return None

    def initial(self, context: Context) -> Column:
        """The value before the first step; by default a null."""
        return F.lit(None).cast("long")

    def step(self, context: Context) -> Step:
        """The step numbered ``context.step``; KeyError if the program doesn't define it, which ends the run."""
        raise KeyError(context.step)

    def before_step(self, context: Context) -> None:
        """Runs on the driver before each step."""

    def after_step(self, context: Context, record: dict) -> None:
        """Runs on the driver after each step, with its record."""


class UniformProgram(VertexProgram):
    """One function for all steps; messages aren't combined."""

    def compute(self, context: Context) -> PregelStep:
        raise NotImplementedError

    def step(self, context: Context) -> PregelStep:
        return self.compute(context)
