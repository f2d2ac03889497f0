"""Spark-native preparation and governance of simulation datasets.

Every function takes and returns DataFrames or Columns; nothing here holds a
sample, a mesh or a manifest in driver memory.
"""
