"""Graph queries: request, planner, executor."""
