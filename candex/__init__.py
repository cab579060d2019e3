"""Selection and extent operators on Spark tables and streams."""
