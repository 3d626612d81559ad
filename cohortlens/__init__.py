"""cohortlens: event-log profiling and cohort modelling on Spark.

Every operator takes and returns DataFrames (or, for fitted models, a small
driver-side coefficient object whose predictions are Column expressions).
The heavy work -- scans, aggregates, ranks, Gram/IRLS partial sums -- runs on
the executors; the driver only ever holds bounded, p-by-p sized state.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Executor-side code (mapInPandas / applyInPandas bodies) is shipped by value,
# so Python workers need no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from cohortlens.session import get_session, ensure_checkpoint_dir, materialize  # noqa: E402

__all__ = ["get_session", "ensure_checkpoint_dir", "materialize"]
