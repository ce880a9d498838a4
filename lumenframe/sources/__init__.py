"""Readers and writers of lists, tables of comma-separated values, logs, XML, JSON and configurations."""
