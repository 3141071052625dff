"""Speech-text evaluation and data preparation as Spark DataFrame jobs.

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns):
Catalyst sees the whole plan, and nothing is collected to the driver.
"""

import sys

from pyspark import cloudpickle

# Arrow UDFs of this package travel to the executors inside the plan, so no executor needs the
# package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
