"""Readers that turn files, JSON bodies, databases and memory into rows with a dense sequence and a verbatim copy."""
