"""Readers and writers: RDF files, query results, mapped tables, statistics."""
