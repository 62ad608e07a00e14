"""Municipal-bond credit marts on PySpark."""
