"""Speech-recognition evaluation analytics as Spark DataFrame programs."""
