"""geostrata: a PySpark-native engine for two-stage geospatial clustering."""

__version__ = "0.1.0"
