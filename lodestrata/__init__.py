"""Spark-native document retrieval, filing analytics and corpus preparation."""

import os
import sys
from pathlib import Path


def _ship() -> None:
    """Sends this package's functions to workers by value where they can't import it themselves."""
    root = str(Path(__file__).resolve().parent.parent)
    if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        from pyspark import cloudpickle

        cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship()
