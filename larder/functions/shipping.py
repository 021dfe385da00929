"""Python functions that run in tasks travel by value, so that workers need not import this library."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
