"""Build and score text / knowledge-graph datasets as Spark jobs."""

import sys

from pyspark import cloudpickle

# Send the few Python helpers along with the tasks that call them, so that the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
