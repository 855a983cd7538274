"""Point-in-time factor, allocation and track-record analytics as Spark DataFrame operators."""
