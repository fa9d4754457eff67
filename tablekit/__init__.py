"""tablekit — Spark-native profiling, validation, feature building, regression and
retrieval over tables.

Every operator takes and returns DataFrames and stays lazy; the only actions are
the documented fits (model training, literal thresholds that a later expression
needs).
"""

from tablekit.session import checkpoint_dir, get_session, load_tables

__all__ = ["get_session", "load_tables", "checkpoint_dir"]
