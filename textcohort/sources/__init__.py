from textcohort.sources.tables import (
    read_table, survey_table, comments_table, scored_table, CLASS_CODE_OF,
)
from textcohort.sources.io import (
    read_delimited, write_delimited, write_predictions, read_predictions,
    write_attributions, read_attributions, write_table, read_table_at, materialize,
)

__all__ = [
    "read_table", "survey_table", "comments_table", "scored_table", "CLASS_CODE_OF",
    "read_delimited", "write_delimited", "write_predictions", "read_predictions",
    "write_attributions", "read_attributions", "write_table", "read_table_at", "materialize",
]
