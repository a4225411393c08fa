"""Scanning and parsing of document corpora, path filters, file and table sinks."""
