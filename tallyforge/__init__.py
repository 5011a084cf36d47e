"""Record analytics on Spark."""

import sys

from pyspark import cloudpickle

# functions travel to the executors with their code, so the package needs to be on the driver only
cloudpickle.register_pickle_by_value(sys.modules[__name__])
