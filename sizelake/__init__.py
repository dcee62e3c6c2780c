"""Document-review analytics expressed as Spark plans."""
