"""corpusloom: labelled-text corpus analytics expressed as Spark jobs.

Every public function takes and returns DataFrames (or Columns).  Rows carry
an explicit ``row_id``; "first" always means the smallest ``row_id``, and all
randomness is an md5 order key, so results do not depend on partitioning.
"""

import sys

from pyspark import cloudpickle

# The code that runs in Python workers is small: it travels with the task, so
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
