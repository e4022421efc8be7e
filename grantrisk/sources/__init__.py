"""Readers and writers: semicolon CSV, libsvm, parquet tables, models, test binding."""
