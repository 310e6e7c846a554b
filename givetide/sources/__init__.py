"""Warehouse tables in, result tables out."""
