"""quarrylake: a PySpark-native engine for media catalogues, message queues and text corpora."""
