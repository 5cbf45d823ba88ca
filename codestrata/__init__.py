"""Source-corpus analytics as Spark jobs over a table of files.

The unit of work is one row of ``files(repo, path, size, mode, mtime, content)``.
Everything that concerns a single file is computed inside that row, so file
text is never shuffled; only narrow per-file or per-repository facts move.
"""
