"""Panel and scenario analytics on Spark.

Every function takes and returns ``DataFrame`` objects keyed by an entity, a scenario
(``future_id``) and an integer period, and builds one lazy plan for all entities at once.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
