"""Programs over facts that arrive as a stream."""

from .maintain import maintain

__all__ = ["maintain"]
