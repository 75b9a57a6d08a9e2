"""URL shape analytics on Spark."""
