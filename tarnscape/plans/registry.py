"""Every registered query of the library proper, with its SQL."""

from tarnscape.plans import documents, geometry, grids, quality, registers, scalars, terrain  # noqa: F401
from tarnscape.plans.base import ORACLE, QUERIES

FLAGSHIP = "i1_sea_share_at_year"

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]
