"""Checkable queries over the driver tables."""

from ringmatch.catalog import (  # noqa: F401
    crops,
    geometry,
    jobs,
    manifests,
    metrics,
    mining,
    patches,
    planning,
    retrieval,
)
from ringmatch.catalog.registry import ORACLES, QUERIES  # noqa: F401
