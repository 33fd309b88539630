"""Data preparation and quality profiling for Spark DataFrames.

Functions that run in tasks are shipped by value, so executors need no copy of
the package.
"""

import sys

from pyspark import cloudpickle

from tableprep.plans.cleaning import CleanConfig, CleanResult, clean
from tableprep.plans.job import run
from tableprep.plans.report import report

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["CleanConfig", "CleanResult", "clean", "report", "run"]
