"""tessera — tabular analytics and ML operators expressed as Spark jobs.

Every public operator takes a ``DataFrame`` (plus column names and
parameters) and returns a ``DataFrame`` or a Spark ML stage, so the same
code runs on ``local[*]`` and on a cluster.  Statistics a later row step
needs travel as one-row DataFrames joined by ``broadcast`` so plans stay
lazy; only metadata-size results (column lists, dictionaries, bin edges)
are ever brought to the driver.
"""

from tessera.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
__version__ = "0.1.0"
