"""Readers and writers of graph tables and artefacts."""
