"""Sources of the surveillance library."""
