"""Lodging-listing analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors' Python with their code: these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
