"""Ontologies, source mappings and their bundles, read from YAML and validated when loaded."""
