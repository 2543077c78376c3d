"""Readers and writers for captured traffic."""
