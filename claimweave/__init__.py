"""Cross-document fact verification and reconciliation on Spark DataFrames."""

from .config import Config

__all__ = ["Config"]
