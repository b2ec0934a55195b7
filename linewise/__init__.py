"""linewise: production-line inspection analytics as PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

from linewise.config import AnalysisConfig, DetectionProfile

__all__ = ["AnalysisConfig", "DetectionProfile"]

# Functions of this package travel to the executors by value, so workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
