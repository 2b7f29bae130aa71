"""Cutting of lineage through the shared checkpoint folder."""

from ..storage import checkpoint_dir, cut

__all__ = ["checkpoint_dir", "cut"]
