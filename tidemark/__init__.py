"""Table synchronisation, change capture and ETL on Spark DataFrames."""

__version__ = "0.1.0"
