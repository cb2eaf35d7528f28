"""All queries with their SQL."""

from repolith.plans import editor, languages, witness

__all__ = ["QUERIES", "SQL", "editor", "languages"]
QUERIES, SQL = witness.QUERIES, witness.SQL
