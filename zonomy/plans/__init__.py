"""All registered queries; importing the package fills the registry."""

from zonomy.plans.base import QUERIES, Tables
from zonomy.plans import (  # noqa: F401
    cleaning, consensus, crops, embeddings, inventory, items, metrics, polygons, rasters, reports, sources, spatial, windows,
)

__all__ = ["QUERIES", "Tables"]
