"""Functions that run on executors travel by value, so a cluster needs no copy of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module: str) -> None:
    """Pickle what this module defines by value; call it as by_value(__name__)."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
