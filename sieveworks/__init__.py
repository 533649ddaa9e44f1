"""sieveworks: Spark-first curation and evaluation of post-training records.

Operators take and return DataFrames and leave planning to Catalyst; Python is
entered only through Arrow batches, where a built-in expression can't say it.
"""
