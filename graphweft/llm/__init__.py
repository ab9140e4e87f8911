"""Operators for training-data pipelines. Nothing else in the package imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions travel to the workers with their code, so that executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
