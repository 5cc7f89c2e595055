"""Listings and scripts rendered from plans, and the session of commands."""
