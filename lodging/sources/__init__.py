"""Readers and writers: CSV sheets, the partitioned booking table, test tables."""
