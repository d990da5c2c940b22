"""The registered queries: a history model on the given tables, Spark queries, SQL."""
