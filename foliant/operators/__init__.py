"""Operators over the catalog, events, folders, changes, check-ins and documents."""
