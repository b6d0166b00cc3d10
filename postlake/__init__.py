"""Job-posting feeds as Spark tables: landing, cleaning, validation, analytics."""
