"""sparklex: text analytics, fuzzy matching, model evaluation and vector search as Spark DataFrame operators."""

__version__ = "0.1.0"
