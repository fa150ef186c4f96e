"""Pure Column expressions: dates, geometry, units, scale axes, model evaluation, run keys."""
