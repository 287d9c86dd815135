"""Operators that prepare training data: scans, scoring, deduplication, search, mixing."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Executors get this package's code with the job; they need not have it installed.
register_pickle_by_value(sys.modules[__name__])
