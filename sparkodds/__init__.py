"""Operators for event-priced time series on Spark: prices that are probabilities,
the order books behind them, and the outcomes that settle them."""

import sys

from pyspark import cloudpickle

# Python helpers travel to the workers by value, so executors need not have the
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
