"""Imports every query module once so the registry is complete."""

from __future__ import annotations

import importlib
import pkgutil

import verification


def load() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(verification.__path__) if m.name.startswith("q_")):
        importlib.import_module(f"verification.{module}")
