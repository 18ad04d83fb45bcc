"""Entity resolution as DataFrame operators: normalise, block, compare, score, resolve, validate."""
