"""Learning structure from large numeric tables with Spark DataFrames.

Self-organizing maps, exact decision trees, voting forests, and the scans,
reductions, sampling and preparation steps around them.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
