"""Column-level building blocks: tile arrays, cell predicates, geometry."""
