"""Operators for training-data corpora.  Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

from . import common, exact_dedup, kneser_ney, line_dedup, merkle, mixing, ngram_join, packing, repetition, secrets, sharding, spelling, tokens, toxicity

# functions travel to the tasks by value, so that executors need no copy of this package
for _module in (common, exact_dedup, kneser_ney, line_dedup, merkle, mixing, ngram_join, packing, repetition, secrets, sharding, spelling, tokens, toxicity):
    cloudpickle.register_pickle_by_value(sys.modules[_module.__name__])
