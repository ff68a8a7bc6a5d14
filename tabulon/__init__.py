"""tabulon: a Spark-native engine for a compact tabular query language, delimited files and table-quality tools."""
