"""partslake: parts-inventory analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames; none creates a session or loops
over collected rows on the driver.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so the package need
# not be installed on every machine.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
