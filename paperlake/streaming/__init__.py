"""The same tables from a stream of files."""
