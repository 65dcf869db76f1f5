from cohortlens.sources.tables import Tables, normalize_headers, read_csv, read_csv_in_order
from cohortlens.sources.zipped import read_zipped_csv, write_zipped_csv

__all__ = ["Tables", "normalize_headers", "read_csv", "read_csv_in_order", "read_zipped_csv", "write_zipped_csv"]
