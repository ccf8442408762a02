"""Reading and writing period-keyed tables and message streams."""
