"""Importing this module registers every plan group."""

from terrane.plans import chain_plans, cost_plans, graph_plans, listing_plans, network_plans, ordered_plans, proximity_plans, raster_plans, relational_plans, segment_plans, service_plans, tiled_plans, walk_plans  # noqa: F401
