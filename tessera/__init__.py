"""tessera: a PySpark-native engine for evidence-based document research.

Every operator takes DataFrames and returns a DataFrame. Nothing here imports
the optional subpackage for training-data work; it is wired in by the driver
contract only if it is present.
"""
