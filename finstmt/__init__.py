"""finstmt: set-at-a-time extraction of financial statements on Spark."""
