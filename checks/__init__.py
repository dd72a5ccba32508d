"""The operators over the given tables, each with an independent SQL statement."""
