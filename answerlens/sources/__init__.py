"""Readers and writers: landed answers, dimension files and the fact tables."""
