"""Readers, writers and the staging views that map the given tables to ledgers, offers, calls and pages."""
