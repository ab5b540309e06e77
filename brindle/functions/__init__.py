"""See the package's README."""
