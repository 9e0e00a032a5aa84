"""lectern — a PySpark-native engine that turns text records into a
searchable, versioned vector corpus and measures retrieval quality.

Every operator is a DataFrame -> DataFrame function; nothing in the core
collects data to the driver except size-checked scalars and bounded
broadcasts.
"""

__version__ = "0.1.0"

import sys as _sys

# Executors run this package's Arrow and pandas steps (splitter, embedder,
# kNN scoring). Pickling its functions and classes by value ships that code
# with each task, so executors need no copy of the package, no
# ``--py-files`` and no PYTHONPATH.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except (ImportError, AttributeError, ValueError):  # pragma: no cover - older cloudpickle
    pass
