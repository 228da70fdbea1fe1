"""Lead-behaviour analytics on Spark: profile, label, featurise, explore, model, score, explain."""
