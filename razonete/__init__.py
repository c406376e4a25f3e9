"""Budget-ledger ingestion on Spark.

Reads batches of budget lines, normalises and validates every row with a
catalogue of rules, rejects whole files that contain faults, upserts accepted
rows into a versioned ledger by business key and answers filtered, sorted and
summarised queries over it, with set-based edits, deletes and an audit trail.

Every operator is a ``DataFrame -> DataFrame`` function built from
``pyspark.sql.functions``; no Python UDF is used anywhere.
"""

__version__ = "0.1.0"
