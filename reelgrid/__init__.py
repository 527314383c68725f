"""reelgrid: Spark operators for media catalogs, timed text and retrieval."""

from reelgrid.session import get_session

__all__ = ["get_session"]
