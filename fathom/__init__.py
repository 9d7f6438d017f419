"""fathom: a PySpark-native analytics engine for sensor, multimodal and text data."""

import sys

from pyspark import cloudpickle

# Worker functions travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
