"""Whole flows: export, backup, verify, restore."""
