"""Imports every query module; ``QUERIES`` and ``ORACLES`` are complete afterwards."""

from latticeqc.queries import geometry_sql  # noqa: F401
from latticeqc.queries import vertex_queries  # noqa: F401
from latticeqc.queries import grid_queries  # noqa: F401
from latticeqc.queries import topology_queries  # noqa: F401
from latticeqc.queries import contract_queries  # noqa: F401
from latticeqc.queries import source_queries  # noqa: F401
from latticeqc.queries import report_queries  # noqa: F401
from latticeqc.queries import volume_queries  # noqa: F401
from latticeqc.queries import eval_queries  # noqa: F401
from latticeqc.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
