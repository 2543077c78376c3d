"""Plan-shape helpers: size-checked broadcasts, skew-safe running totals, sequential folds."""
