"""Review analytics on PySpark: sessions, rankings, similarity groups, edit logs, metrics and text corpora."""
