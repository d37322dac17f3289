"""Terrain, heritage-register and training-data analytics as Spark jobs."""
