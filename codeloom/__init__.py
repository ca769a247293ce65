"""Corpus graph analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# executors receive the package's functions by value: nothing to install there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from codeloom.session import build_session, cut_lineage, tune  # noqa: E402

__all__ = ["build_session", "cut_lineage", "tune"]
