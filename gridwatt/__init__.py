"""Weather and energy forecast analytics as plain PySpark DataFrame functions."""
