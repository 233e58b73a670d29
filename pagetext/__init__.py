"""pagetext: page-text analytics as PySpark DataFrame and stream operators."""

import sys

from pyspark import cloudpickle

# Python workers get our few helper functions with the task, so nothing has to be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
