"""tickvault: a temporal warehouse of financial prices as Spark DataFrame operators.

Every operator is table-in / table-out: it takes DataFrames (and plain
parameters) and returns a DataFrame, answering for *all* keys in one job.
"""

from tickvault.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]
