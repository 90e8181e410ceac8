"""quern: evaluation-data cleaning, reconciliation and ranking on PySpark.

Every operator takes DataFrames and returns lazy DataFrames; nothing here
collects rows to the driver except small, size-checked configuration tables.
"""

__version__ = "0.1.0"
