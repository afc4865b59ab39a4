"""Composed flows, the adapters over the driver tables, and the registered queries."""


def all_queries():
    """(queries, oracle SQL), after loading every module that registers some."""
    from importlib import import_module
    from pkgutil import iter_modules

    from planlens.plans.registry import ORACLE, QUERIES
    for m in sorted(m.name for m in iter_modules(__path__) if m.name.startswith("q_")):
        import_module(f"{__name__}.{m}")
    return QUERIES, ORACLE
