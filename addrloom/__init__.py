"""Address matching at table scale, written as Spark DataFrame operations."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so the package need not be
# installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
