"""ringmatch: panorama-to-gallery retrieval analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
