"""Document parsers and the chunk store."""
