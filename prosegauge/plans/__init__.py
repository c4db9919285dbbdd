"""Rule registry, scoring and report plans."""
