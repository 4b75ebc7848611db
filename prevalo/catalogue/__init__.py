"""Registered queries over claims derived from the star-schema tables, with their check SQL."""
