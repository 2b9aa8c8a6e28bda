"""Queries over the test tables, each with its SQL equivalent where SQL can express it."""

from labelrank.queries import evaluating, modelling, preparing, ranking, splitting, storing  # noqa: F401
from labelrank.queries.base import ORACLES, QUERIES  # noqa: F401
