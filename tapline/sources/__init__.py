"""Readers and writers: field exports, packet JSON, capture files, case tables."""
