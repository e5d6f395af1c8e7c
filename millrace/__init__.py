"""millrace: a Spark-first engine for statement matching and ledger keeping."""
