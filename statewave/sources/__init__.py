"""Readers that turn files and event tables into the long signal schema."""
