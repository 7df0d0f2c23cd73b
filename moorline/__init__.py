"""An engine for ontologies, entity resolution, lineage and graph traversal on Spark DataFrames."""
