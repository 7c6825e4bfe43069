"""Geospatial table analytics expressed as PySpark DataFrame jobs."""

from geoloom.layer import Layer
from geoloom.shipping import ship

__all__ = ["Layer", "ship"]
