"""All registered queries. Importing this package fills the registry."""

import importlib
import pkgutil

from voxmill.catalog.registry import CHECKS, QUERIES, SURVEY, runner

for _m in sorted(m.name for m in pkgutil.iter_modules(__path__)):
    if _m != "registry":
        importlib.import_module(f"{__name__}.{_m}")

__all__ = ["CHECKS", "QUERIES", "SURVEY", "runner"]
