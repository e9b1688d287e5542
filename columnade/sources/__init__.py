"""Tables to run expressions on."""

from columnade.sources.tables import json_document, json_documents, json_rows, json_table, read_table, write_ids

__all__ = ["json_document", "json_documents", "json_rows", "json_table", "read_table", "write_ids"]
