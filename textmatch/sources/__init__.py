"""Readers, writers and the views that bind given tables to postings, profiles, blocks and edits."""
