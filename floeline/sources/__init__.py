"""Readers, catalog tables, scratch storage and derived inputs."""
