"""Readers: tar shards, score logs, prompt lists, label tables and file pairs."""
