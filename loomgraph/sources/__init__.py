"""Reading graphs, run metrics and results, and writing them."""

from .results import read_logs, read_properties, read_results
from .text import read_edges, read_metrics, read_vertices, write_metrics, write_vertices

__all__ = ["read_edges", "read_logs", "read_metrics", "read_properties", "read_results", "read_vertices", "write_metrics", "write_vertices"]
