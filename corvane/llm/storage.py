"""Tables that cut lineage, as the rest of the library writes them."""

from ..tables import fresh_name, materialize, new_folder, read_table, remove, scratch_root, temporary_tables

__all__ = ["fresh_name", "materialize", "new_folder", "read_table", "remove", "scratch_root", "temporary_tables"]
