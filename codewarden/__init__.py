"""Code-security analytics over tables of many repositories, as Spark plans."""

import sys

from pyspark import cloudpickle

# The few Python helpers travel to the executors by value: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
