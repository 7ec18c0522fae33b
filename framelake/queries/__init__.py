"""Registered queries, one module per area."""
import importlib
import pkgutil

from framelake.registry import ORACLES, QUERIES


def load():
    for m in sorted(x.name for x in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{m}")
    return QUERIES, ORACLES
