"""Files that keep arriving: chunking and running statistics."""
