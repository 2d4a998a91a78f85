"""Operators of a training-data pipeline: archive, deduplicate, filter, scan, mix.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their modules' code, so executors
# need Spark, numpy and pyarrow, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
