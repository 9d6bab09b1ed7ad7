"""Spark jobs for web-content extraction, merging, cleaning and reading analytics."""

import sys

from pyspark import cloudpickle

from folioweave.session import build_session, checkpointed

# Executors then need no copy of the package: the few Python helpers travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "checkpointed"]
__version__ = "0.1.0"
