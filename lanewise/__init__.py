"""Traffic-crossing analytics over DataFrames: tracks, plates, duplicates, matching, telemetry and reports."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the query, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
