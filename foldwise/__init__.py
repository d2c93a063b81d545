"""foldwise: tabular audit, feature, evaluation and corpus operators on Spark DataFrames."""
