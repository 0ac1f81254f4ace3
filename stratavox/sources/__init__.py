"""Readers and writers of array, imaging and archive files."""
