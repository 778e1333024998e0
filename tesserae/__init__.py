"""tesserae: a literature retrieval and data processing engine on Spark DataFrames."""

__version__ = "0.1.0"
