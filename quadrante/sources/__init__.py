from quadrante.sources.geojson import parse_features, read_feature_lines, read_features
from quadrante.sources.rows import accepted_rows, decode_json_rows, parse_json_rows, read_json_rows, rejected_rows, require_columns
from quadrante.sources.tables import JdbcRange, conform, equal_cuts, jdbc_url, key_ranges, load_tables, load_tables_jdbc

__all__ = [
    "JdbcRange",
    "accepted_rows",
    "conform",
    "decode_json_rows",
    "equal_cuts",
    "jdbc_url",
    "key_ranges",
    "load_tables",
    "load_tables_jdbc",
    "parse_features",
    "parse_json_rows",
    "read_feature_lines",
    "read_features",
    "read_json_rows",
    "rejected_rows",
    "require_columns",
]
