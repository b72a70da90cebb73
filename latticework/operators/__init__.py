"""DataFrame-to-DataFrame operators, all keyed by structure_id."""
