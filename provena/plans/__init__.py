"""Registered queries of the engine and the SQL they are held against."""
