"""Spark-native analytics for annotated translations, lyric corpora and topic features."""

__version__ = "0.1.0"
