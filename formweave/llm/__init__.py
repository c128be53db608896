"""Operators of a training-data pipeline: archives, tokens, packing, search, near-copies, filters.

Nothing else in the library imports this subpackage.  Functions that run in
Python workers are sent by value, so executors need no installed package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])


def queries():
    from formweave.llm import plans

    return dict(plans.QUERIES)


def oracles():
    from formweave.llm import plans

    return dict(plans.ORACLES)
