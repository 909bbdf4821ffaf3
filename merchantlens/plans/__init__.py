"""The silver and gold models, the reader views on them, and the order they are built in."""
