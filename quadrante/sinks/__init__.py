from quadrante.sinks.json import to_json_rows, write_json, write_tables

__all__ = ["to_json_rows", "write_json", "write_tables"]
