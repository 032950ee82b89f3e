from clickwright.sources.clicklog import clicklog, read_table, CLICKLOG_SQL  # noqa: F401
from clickwright.sources.files import (  # noqa: F401
    read_log, read_log_limited, read_csv, read_labels_headerless, write_log, write_csv,
    write_labels_headerless, concat_columns_by_position, save_dataset, load_dataset, export_csv, row_count,
)
