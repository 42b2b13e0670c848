"""Column-level building blocks: time arithmetic, statistics and decision rules."""
