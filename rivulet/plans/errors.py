class QueryError(ValueError):
    """A query that can't be parsed, or names what isn't there."""


class UnsupportedQuery(QueryError):
    """A stage that can't run where it stands; it is refused, never dropped."""
