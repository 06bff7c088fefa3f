"""Retrieval and RAG analytics as Spark jobs: chunking, BM25, vector top-k, rank
fusion under access rules, and the evaluation and usage reports around them."""

import sys

from pyspark import cloudpickle

# The few Arrow helpers in this package are shipped by value, so executors need no
# copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
