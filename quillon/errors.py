class QueryError(ValueError):
    """A request that the schema, the grammar or the caller's rules do not allow."""
