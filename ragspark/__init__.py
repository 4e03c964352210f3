"""Document, question and answer processing for retrieval-augmented QA, on Spark.

Every public function takes DataFrames or Columns and returns them; nothing is
executed until the caller runs an action, apart from the size checks that the
docstrings name.
"""

__version__ = "0.1.0"
