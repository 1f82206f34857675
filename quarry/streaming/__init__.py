"""Incremental upkeep of layers from a stream of changed files."""
