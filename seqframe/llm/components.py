"""Connected components of links, as the library finds them."""

from ..operators.graph import components

__all__ = ["components"]
