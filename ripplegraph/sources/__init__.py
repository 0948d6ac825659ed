"""Readers that turn landed files into staged entity and connection rows."""
