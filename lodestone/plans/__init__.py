"""Plan-level helpers: shared scratch tables, distributed running sums, pipelines from configuration."""
