"""Rule-text analytics as Spark DataFrame jobs.

Every operator is a plain function from DataFrames to DataFrames (or from Columns to a
Column); vocabularies, weights and rules are arguments with defaults in
``rulegrain.functions.vocab``.
"""

__version__ = "0.1.0"
