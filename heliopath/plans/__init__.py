"""Registered queries over the test tables."""


def load():
    """(queries, oracle SQL) of every query module."""
    from importlib import import_module
    from pkgutil import iter_modules

    from .registry import ORACLES, QUERIES

    for module in sorted(m.name for m in iter_modules(__path__)):
        if module.endswith("_queries"):
            import_module(f"{__name__}.{module}")
    return QUERIES, ORACLES
