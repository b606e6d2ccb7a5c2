"""colloquy: conversation analytics and training-data operators on Spark."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: the functions that run there travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
