"""Readers and writers for logger files."""
