"""factloom: a fact store, pattern-query and rewriting engine on PySpark."""
