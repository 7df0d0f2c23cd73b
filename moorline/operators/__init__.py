"""Distributed operators: mapping, blocking, scoring, clustering, fusion, links, evaluation, lineage."""
