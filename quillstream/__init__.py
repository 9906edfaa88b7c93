"""quillstream: a PySpark-native engine for transcript text, job logs and document corpora."""

__version__ = "0.1.0"
