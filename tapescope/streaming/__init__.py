"""Streaming of the surveillance library."""
