"""Operators on training documents, their queries and the SQL of those."""
