"""Training-data operators: deduplication, token counts, quality scoring,
chat formatting, source mixing and benchmark decontamination.

Nothing else in the library imports this subpackage; ``queries.py`` registers
its queries for ``__spark_entry__.py``.

Functions that run inside tasks are pickled by value, so executors need numpy
and pyarrow but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
