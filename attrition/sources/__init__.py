"""Sources and sinks: warehouse reads (S1-S4), a source that takes filters, table writes
as versioned snapshots (S5), role views."""

from attrition.sources.bundle import DEFAULT_TABLES, ChurnSources
from attrition.sources.roles import role_sources
from attrition.sources.tables import read_table, save_training_table, training_rows

__all__ = [
    "DEFAULT_TABLES",
    "ChurnSources",
    "role_sources",
    "read_table",
    "save_training_table",
    "training_rows",
]
