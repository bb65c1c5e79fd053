"""DuckDB statements that check the registered queries independently of Spark."""
