"""Point-in-time features and decision replay over bitemporal fact logs, on Spark."""
