"""Queries over the driver tables: one per operator, each with its check SQL."""

import importlib
import pkgutil


def load_all() -> None:
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"workloads.{module.name}")
