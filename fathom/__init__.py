"""fathom: document ingestion and hybrid retrieval as PySpark DataFrame plans."""

__version__ = "0.1.0"
