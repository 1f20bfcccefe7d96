"""strata: medallion analytics operators on PySpark DataFrames."""

__version__ = "0.1.0"
