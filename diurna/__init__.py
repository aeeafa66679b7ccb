"""diurna: Spark-native daily demand analytics.

Pure ``DataFrame -> DataFrame`` operators: roll-up of hourly logs by column role,
repair, profiles, audits, encoding, splits, model fitting and evaluation,
permutation importance and isolation-forest anomalies with causes.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Task functions travel to the executors by value, so that these need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
