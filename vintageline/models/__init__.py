"""Default models trained on Spark."""
