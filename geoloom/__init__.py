"""geoloom: raster, tile and point analytics expressed as Spark DataFrame plans."""
