"""Readers and writers of tab-separated record and list files."""
