"""All registered queries."""

from siftmill.queries import features, metrics, modelling, quality, runs, screening, tables, time  # noqa: F401
from siftmill.queries.base import COVERS, ORACLES, QUERIES

FLAGSHIP = features.flagship

__all__ = ["COVERS", "FLAGSHIP", "ORACLES", "QUERIES"]
