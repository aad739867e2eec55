"""Network-flow anomaly analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from flowmarrow.session import scratch_path, session, shared_dir

# executors need not have the package: its functions travel with the tasks that use them
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["scratch_path", "session", "shared_dir"]
