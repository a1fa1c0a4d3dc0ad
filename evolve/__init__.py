"""evolve: versioned-change bookkeeping for fleets of databases and tables, on Spark.

Scripts, hooks, execution logs and change histories are plain DataFrames.  Every
operator takes DataFrames and returns a DataFrame; nothing is collected to the
driver.  ``target_id`` (one database / table under management) and ``project``
(one set of script folders) are ordinary key columns, so a single job answers a
question for every target of a fleet at once.
"""

from evolve.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
