"""Specifications of listings, and the library's queries."""
