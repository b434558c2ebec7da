"""Table profiling, cleaning and model ranking as Spark jobs.

Every operator takes and returns a DataFrame.  Statistics are fitted in
separate aggregate jobs whose results are a few numbers per column, and are
then applied as plain column expressions, so a fitted step is a projection or
a filter that Catalyst can merge with its neighbours.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so a cluster needs no copy of
# this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
