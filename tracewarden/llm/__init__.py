"""Operators of a training-data pipeline: mixing, filtering, deduplication, packing, encoding."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the workers with their query, so a worker needs PySpark,
# numpy and pyarrow, but no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
