"""Readers and writers of facts."""
