"""Readers and writers: property documents, tabular exports, dimension tables, sinks."""
