"""cellcast: reference-period lookup, calibration and evaluation on Spark.

Every operator takes and returns ``pyspark.sql.DataFrame`` objects and is built
from DataFrame/SQL expressions only (no Python UDFs, nothing collected to the
driver).  Sub-packages:

* ``sources``   – scans, the observation fixture, prediction files, sinks
* ``functions`` – column expressions (time keys, geohash, clipping, encodings)
* ``operators`` – aggregates, lookups, calibration, cascades, as-of, lags,
                  features, blends, metrics, profiles, models
* ``plans``     – the registered queries and their DuckDB oracle texts
* ``streaming`` – scoring a stream of target rows against static lookups
"""

__version__ = "0.1.0"
