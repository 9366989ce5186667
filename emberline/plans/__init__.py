"""All queries of the engine proper and their SQL."""
