"""Questions on streams: the condition of a question is stateless, so it marks or filters a streaming DataFrame as it is."""

from ..api import fetch_items, mark_items

__all__ = ["fetch_items", "mark_items"]
