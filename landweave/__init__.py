"""Spark-first analytics for geolocated text and land-cover supervision."""

__version__ = "0.1.0"
