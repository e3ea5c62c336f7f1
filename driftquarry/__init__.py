"""Distribution-divergence analytics on Spark."""
