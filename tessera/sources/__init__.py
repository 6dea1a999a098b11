from tessera.sources.catalog import columns_of, columns_of_catalog, columns_of_frames, from_rows, read_table, tables_of
from tessera.sources.files import CSV_OPTIONS, csv_reader, path_columns, read_csv, select_files, with_file_path

__all__ = ["columns_of", "columns_of_catalog", "columns_of_frames", "from_rows", "read_table", "tables_of",
           "CSV_OPTIONS", "csv_reader", "path_columns", "read_csv", "select_files", "with_file_path"]
