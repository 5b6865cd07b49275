"""karwan: catalogue retrieval, record hygiene and session analytics as PySpark plans."""

import sys

from pyspark import cloudpickle

# Functions travel to the workers by value, so that these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
