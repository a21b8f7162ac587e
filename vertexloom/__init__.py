"""vertexloom: graph analytics over edge lists, as DataFrame programs."""

from vertexloom.graph import Graph
from vertexloom.session import session

__all__ = ["Graph", "session"]
