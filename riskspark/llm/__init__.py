"""Operators of a training-data pipeline over documents, pages, conversations
and embeddings.  Nothing outside this folder (and ``corpus_pipeline.py``)
imports it."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the plan; executors need no copy of this folder
cloudpickle.register_pickle_by_value(sys.modules[__name__])
