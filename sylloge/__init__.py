"""sylloge: deductive analytics over Spark DataFrames."""
