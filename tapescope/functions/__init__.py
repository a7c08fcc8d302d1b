"""Functions of the surveillance library."""
