"""Driver-side planning: strings to predicates, and composed query plans."""
