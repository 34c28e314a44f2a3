"""Lectern: curated-content analytics and training-data operators on Spark."""
