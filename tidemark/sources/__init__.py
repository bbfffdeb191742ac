from tidemark.sources.readers import (  # noqa: F401
    file_inventory,
    latest_run,
    list_tables,
    read_csv,
    read_path,
    read_table,
    rows,
    run_sql,
    table_columns,
)
