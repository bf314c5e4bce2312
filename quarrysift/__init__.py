"""quarrysift: a Spark-native engine for curating and evaluating code and text corpora."""

__version__ = "0.1.0"
