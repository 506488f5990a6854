"""Evidence retrieval and attribution analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
