"""Registered queries over the shared tables, each next to the SQL that must give the same rows."""

from catalog import (  # noqa: F401
    cleaning,
    comparison,
    forecasting,
    models,
    reporting,
    resampling,
    statistics,
    storage,
    windows,
)
from catalog.base import REGISTRY  # noqa: F401
