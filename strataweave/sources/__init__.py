"""Tables in, tables out."""

from strataweave.sources.storage import intermediates, materialize, shared_dir
from strataweave.sources.tables import TABLES, register_views, table

__all__ = ["TABLES", "intermediates", "materialize", "register_views", "shared_dir", "table"]
