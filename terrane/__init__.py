"""Multilevel computation on graphs, meshes and point clouds, and analytics over it, as Spark DataFrames."""
