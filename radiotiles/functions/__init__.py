"""functions of the radio path-loss engine."""
