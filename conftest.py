"""Puts the repository's root on the path of the tests."""
