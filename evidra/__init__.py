"""Evidence retrieval and entity-network analysis as Spark jobs."""

from evidra.session import get_session, load_table

__all__ = ["get_session", "load_table"]
__version__ = "0.1.0"
