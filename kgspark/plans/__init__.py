"""Compositions: the service, and the queries over the star-schema tables."""
