"""Layered (Bronze -> Silver -> Gold) data preparation as PySpark DataFrame jobs."""
