"""DataFrame operators: lookups, scoring, comparison, roll-ups, mixing, nesting, inference."""
