"""The usual graph algorithms as vertex programs, by the published benchmark definitions."""

from .programs import bfs, cdlp, lcc, pagerank, sssp, triangles, wcc

__all__ = ["bfs", "cdlp", "lcc", "pagerank", "sssp", "triangles", "wcc"]
