"""Analytics on annotated count matrices and labelled points, written for Spark."""

import sys

from pyspark import cloudpickle

# functions sent to Python workers travel with their code: workers need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
