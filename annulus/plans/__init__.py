"""Named queries over the tables."""

from . import around, estimates, frames, rasters, scalars, sky, stacks, texts  # noqa: F401
from .catalogue import ORACLE, QUERIES  # noqa: F401
