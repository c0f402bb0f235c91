"""RDF graphs as Spark DataFrames: patterns, joins, paths, aggregates, updates, readers and writers."""
