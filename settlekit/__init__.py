"""settlekit — order / return / settlement reconciliation on Spark.

Every operator takes DataFrames and returns a DataFrame. No data is
collected to the driver inside an operator; the caller decides where the
actions (writes, ``collect`` of a one-row summary) happen.

Main entry points::

    from settlekit import clean, merge_latest, analyze, run_batch, incremental_run
"""

from settlekit.session import checkpoint_dir, get_session  # noqa: F401

_LAZY = {
    "clean": ("settlekit.operators.cleanse", "clean"),
    "merge_latest": ("settlekit.operators.merge", "merge_latest"),
    "analyze": ("settlekit.operators.analyze", "analyze"),
    "run_batch": ("settlekit.plans.batch", "run_batch"),
    "incremental_run": ("settlekit.streaming.incremental", "incremental_run"),
    "scan_tolerant": ("settlekit.sources.csv", "scan_tolerant"),
}

__all__ = ["get_session", "checkpoint_dir", *_LAZY]


def __getattr__(name):
    if name in _LAZY:
        import importlib
        module, attr = _LAZY[name]
        return getattr(importlib.import_module(module), attr)
    raise AttributeError(name)
