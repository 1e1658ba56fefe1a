"""Reading, keyed updates and incremental reads of tables."""
