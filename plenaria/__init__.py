"""plenaria: a PySpark-native engine for deliberation records (entities, transcripts, votes)."""

__version__ = "0.1.0"
