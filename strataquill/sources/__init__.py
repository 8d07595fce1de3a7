"""Readers and writers: file trees, snapshot tables."""
