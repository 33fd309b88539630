"""Operators for preparing training text: scans, deduplication, mixing, sharding.

Nothing outside this package imports it; ``queries`` holds the queries over
the test tables. Its functions are shipped to the tasks by value, so executors
need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
