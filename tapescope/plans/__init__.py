"""Plans of the surveillance library."""
