"""Spark-native risk analytics for public grant agreements.

Operators are plain functions ``DataFrame, column names -> DataFrame`` built
on Spark SQL.  Sub-packages:

* ``sources``   – readers/writers (semicolon CSV, libsvm, tables, models)
* ``functions`` – scalar column expressions (bands, dates, shares, repair)
* ``operators`` – relational, ranking, preparation, balancing, metrics, learning
* ``plans``     – the ETL / training / report pipelines and registered queries
* ``streaming`` – incremental (file-stream) append load of source extracts
"""

__version__ = "0.1.0"
