"""All named queries."""

from .base import ORACLE, QUERIES  # noqa: F401
from . import baselines, scalars, rasters, spatials, detect, reports, files, learning, streams  # noqa: F401
