"""Composite jobs: what a user of the package calls."""
