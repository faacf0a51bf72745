"""Generation and encoding on streams: both are projections with small static joins."""
