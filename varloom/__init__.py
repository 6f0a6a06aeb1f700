"""varloom: variant analytics and training-data preparation as Spark plans."""
