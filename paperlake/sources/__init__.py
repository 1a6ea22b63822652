"""PDF bytes to rows."""
