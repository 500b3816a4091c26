"""Readers and writers: manifests, saved pages, URL lists, table snapshots."""
