"""Pure column expressions: numbers, times, scores, levels, geometry, masks."""
