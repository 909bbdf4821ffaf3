"""Every operator as a query on the test tables, and the same result as DuckDB SQL."""
