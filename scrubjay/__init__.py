"""Data-quality assessment and replayable cleaning of tables, as Spark plans."""
