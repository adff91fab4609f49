"""Research-table analytics on Spark."""
