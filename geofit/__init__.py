"""geofit: multi-criteria ranking of places as Spark DataFrame jobs."""
