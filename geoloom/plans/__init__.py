"""The registered queries: every operator over the layers derived from the driver tables."""


def all_queries():
    """(queries by name, oracle SQL by name)."""
    from geoloom.plans import registry
    from geoloom.plans import filters_and_pages, joins_and_aggregates, sources_and_streams  # noqa: F401

    return dict(registry.QUERIES), dict(registry.ORACLES)
