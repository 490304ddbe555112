"""DataFrame -> DataFrame operators, keyed by site."""
