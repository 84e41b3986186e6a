"""Customer purchase analytics as Spark DataFrame operators."""

from farebox.plans.workspace import Workspace
from farebox.sources.reader import read_purchases

__all__ = ["Workspace", "read_purchases"]
