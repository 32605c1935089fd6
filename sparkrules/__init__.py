"""Corpus work on (clause text, rule string) pairs, expressed as Spark DataFrame plans.

Sub-packages
------------
sources    reading and writing corpora, line files, mixtures and metric logs
functions  Column -> Column text, quantity and run-name functions
operators  DataFrame -> DataFrame jobs: curate, sample, retrieve, nodes, score, runs
plans      registered queries over the test tables and their SQL twins
streaming  the row-wise functions applied to a file stream
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
