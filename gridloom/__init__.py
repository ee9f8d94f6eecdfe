"""gridloom: analytics over visual-grounding data, written for Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package reach the executors by value, so a cluster needs no copy of it on the workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
