"""tidemill: a Spark-first analytics engine with MySQL-flavoured semantics."""

__version__ = "0.1.0"
