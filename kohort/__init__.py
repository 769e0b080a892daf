"""kohort: registry cleaning, cohort derivation and survival analytics on Spark.

Every public function takes and returns ``pyspark.sql.DataFrame`` (or a
``Column`` for scalar helpers) and stays inside Catalyst: no RDDs, no
row-at-a-time Python UDFs.  See README.md for the module map.
"""

__version__ = "0.1.0"
