"""strataquill: a Spark-native analytics engine for versioned file snapshots and text corpora."""

__version__ = "0.1.0"
