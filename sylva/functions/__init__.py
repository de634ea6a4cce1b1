"""Part of the sylva tree engine."""
