"""PDF corpora as Spark tables: parse, query, rewrite and write many documents at once."""

__version__ = "0.1.0"
