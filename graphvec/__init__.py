"""Property graphs, vector search and corpus operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from .functions.similarity import COSINE, DOT, EUCLIDEAN, VectorConfig
from .operators.graph import Edge, GraphStats, Node, PropertyGraph
from .operators.store import GraphStore, Transaction
from .plans.paging import Page
from .sources.storage import MemoryStorage, ParquetStorage
from .sources.views import NODE_KEYS, View, typed_view

__all__ = ["COSINE", "DOT", "EUCLIDEAN", "Edge", "GraphStats", "GraphStore", "MemoryStorage", "NODE_KEYS", "Node", "Page", "ParquetStorage", "PropertyGraph", "Transaction", "VectorConfig", "View", "typed_view"]

# Functions sent to Python workers travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
