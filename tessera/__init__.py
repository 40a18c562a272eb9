"""Tessera: a PySpark-native analytics engine built on DataFrames and Catalyst."""
