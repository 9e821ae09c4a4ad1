from bipath.sinks.files import append_edges, insert_into_table, overwrite_csv, publish, write_lines

__all__ = ["append_edges", "insert_into_table", "overwrite_csv", "publish", "write_lines"]
