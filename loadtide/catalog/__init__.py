"""Named queries over the given tables."""
import importlib
import pkgutil


def load():
    """Import every query module and return (queries, sql)."""
    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if m.name.startswith("queries_"):
            importlib.import_module(f"{__name__}.{m.name}")
    from loadtide.catalog.registry import QUERIES, SQL
    return QUERIES, SQL
