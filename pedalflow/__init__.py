"""Station demand, availability and rebalancing on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks travel with their code: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
