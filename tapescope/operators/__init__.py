"""Operators of the surveillance library."""
