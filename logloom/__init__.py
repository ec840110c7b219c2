"""Security-log mapping, search and schema analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Ship the functions that run inside tasks by value, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
