"""millrace: a Spark-first engine for relational, time-series and corpus work.

An operator is a builder that returns a ``DataFrame``; Catalyst picks the physical plan.
Those that need statistics first run jobs while they build it.  Python only runs where no built-in expression has the semantics,
and then on Arrow batches.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors need not have the package installed: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
