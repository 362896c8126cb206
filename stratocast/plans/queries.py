"""All registered queries, in registry order."""

from __future__ import annotations

from . import catalog
from . import catalog_eval  # noqa: F401
from . import catalog_drift  # noqa: F401
from . import catalog_prep  # noqa: F401
from . import catalog_monitor  # noqa: F401
from . import catalog_stream  # noqa: F401

REGISTRY = catalog.REGISTRY
