"""Registered queries, the SQL that checks them, and the local session they share."""
