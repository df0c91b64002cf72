"""gapspark: under-explored topics in bibliographic corpora, on Spark."""
