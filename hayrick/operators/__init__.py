"""DataFrame operators of the retrieval engine."""
