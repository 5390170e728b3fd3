"""Named queries over the driver's tables; load() registers them."""


def load() -> None:
    from . import geometry_queries, matching_queries, raster_queries  # noqa: F401
