"""strataspark: survey, point-cloud, raster and adjustment analytics as Spark plans."""
