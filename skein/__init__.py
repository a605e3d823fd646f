"""skein: document search, metadata analytics and corpus preparation as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so that executors need not have
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
