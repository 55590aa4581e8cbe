"""stratalog: log, state and storage analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions sent to executors are pickled by value: a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
