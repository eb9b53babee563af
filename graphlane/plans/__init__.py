"""Building blocks of multi-step plans: written tables, supersteps, connected components."""
