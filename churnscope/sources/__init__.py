from churnscope.sources import bindings
from churnscope.sources.tables import SCHEMAS, read_table, table_path, table_reader

__all__ = ["SCHEMAS", "bindings", "read_table", "table_path", "table_reader"]
