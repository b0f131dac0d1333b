"""hazardframe: wildfire and evacuation analytics as Spark DataFrame operations."""
