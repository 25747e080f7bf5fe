"""Checks of tables that keep growing."""
