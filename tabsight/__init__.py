"""tabsight: table profiling, cleaning and analysis as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Arrow functions travel to the executors with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
