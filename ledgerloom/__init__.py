"""A PySpark-native engine for retail-inventory data: sources, operators, plans and streams over DataFrames."""

import sys

from pyspark import cloudpickle

# executors need no copy of the package: its functions travel with the tasks that call them
cloudpickle.register_pickle_by_value(sys.modules[__name__])
