"""Query modules; load() imports each of them once, which registers its queries."""

import importlib

MODULES = ["curves", "tables", "models", "reports", "feature_sql", "remaps"]


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"tidewatch.plans.{name}")
