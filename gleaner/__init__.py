"""gleaner: candidate generation and corpus preparation as Spark DataFrame operators."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in Python workers travel with their code: executors need no installed copy of the package.
register_pickle_by_value(sys.modules[__name__])
