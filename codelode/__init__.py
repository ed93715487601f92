"""codelode: retrieval and structural analysis over code and text collections, expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: functions sent to them carry their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
