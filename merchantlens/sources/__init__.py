"""Bronze landing: CSV tables, indicator pages, trade-flow replies, and the full-refresh table sink."""
