"""Spark ML: encoders, exact imputers, OLS via Gram matrices, forward selection, trees, metrics."""

import sys

from pyspark import cloudpickle

# kernels are shipped to the workers by value: executors need numpy, pandas and pyarrow but not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
