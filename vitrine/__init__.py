"""Media-catalogue analytics as lazy PySpark DataFrame functions."""
