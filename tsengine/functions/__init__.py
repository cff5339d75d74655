"""Functions that pipeline stages apply to query results."""
