"""Document anonymisation and data preparation as Spark plans."""
