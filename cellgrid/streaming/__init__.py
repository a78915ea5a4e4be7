"""Counting operators over a growing folder of transcript files."""
