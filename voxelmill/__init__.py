"""Spark operators over 3-D image volumes, segmentation masks and study tables."""

import sys

from pyspark import cloudpickle

# task functions travel with the job, so workers need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
