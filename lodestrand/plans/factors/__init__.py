"""Factor sets as formulas."""
