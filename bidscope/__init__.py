"""bidscope: change tracking and market analytics for periodically observed auction listings, on Spark.

Every operator is a function ``f(df, ..., as_of) -> DataFrame`` built from Spark's own expressions, joins,
windows and aggregates. Sub-packages:

* ``functions``  column expressions (normalisation, parsing, classification, formatting)
* ``sources``    snapshot / state / scan-log files, HTML harvest, the fixture adapter
* ``operators``  predicates, entity matching, history windows, market aggregates, ranking, enrichment
* ``plans``      composite jobs: rebuild, dedup, publish, listing query, digest
* ``streaming``  Structured Streaming variants of the rebuild
* ``catalog``    registry of named queries over the test tables and their SQL oracles
"""

__version__ = "0.1.0"
