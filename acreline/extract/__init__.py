"""Listings out of pages, where patterns alone cannot follow the nesting of tags."""
