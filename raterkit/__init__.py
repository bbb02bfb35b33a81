"""raterkit: repeated-measures reliability analysis of automated essay raters on Spark.

Every public function takes and returns Spark DataFrames (or Columns) and is
built from native Spark SQL expressions, aggregations, joins and windows.
"""

__version__ = "0.1.0"
