"""Readers and writers. Every reader takes an explicit schema."""
