"""Table operators: ``DataFrame, column names -> DataFrame``."""
