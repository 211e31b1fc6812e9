"""Readers and writers: tables, nested JSON, reports, HTML, layouts, folders, keyed overwrites."""
