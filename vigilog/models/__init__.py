"""Models: fitted on Spark, scored in columns or vectorised functions."""
