"""palaver: meeting-transcript analytics as Spark DataFrame operators."""
