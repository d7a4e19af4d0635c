"""Training-data pipeline operators on Spark.

Each operator is a function DataFrame -> DataFrame in its own module; ``queries`` applies them to
the given tables. Python kernels of this package are shipped to the workers by value, so that
executors need numpy, zstandard, xxhash and sentencepiece but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
