"""Point-in-time panel analytics as Spark jobs."""
