"""Connected components of a table of links, as the library's operators have them."""

from __future__ import annotations

from ..operators.components import components

__all__ = ["components"]
