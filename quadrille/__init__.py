"""Tiled map-geometry analytics and training-data operators planned as Spark DataFrames."""
