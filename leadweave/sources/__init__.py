"""Scans and sinks: tables, text files, logs, exports."""
