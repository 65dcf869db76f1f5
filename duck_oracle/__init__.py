"""Independent DuckDB oracle: the adapter views and one SQL text per query key."""
