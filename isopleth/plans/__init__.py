"""Variable registry, derivations and the query builder."""
