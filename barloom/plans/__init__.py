"""Plan building blocks: intermediate tables, skew-safe lookups, staged feature plans."""
