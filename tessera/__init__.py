"""tessera: structured columns, relational and graph operators as plain Spark plans."""
