"""Readers and writers: snapshot CSV folders, role tables, upserts."""
