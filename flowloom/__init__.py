"""Packet-capture analytics on Spark: sources, decoding, flows, archives and sinks."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so only the driver needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
