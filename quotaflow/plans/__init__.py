"""Plan-level helpers: size-checked broadcast, one-scan rollup bundles and
plan inspection."""
