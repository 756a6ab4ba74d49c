"""Readers and writers of the line and binary formats."""
