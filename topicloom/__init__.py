"""topicloom: topic extraction and category tagging for search queries on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Helpers used inside Arrow batches travel with the job, so executors do not
# need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
