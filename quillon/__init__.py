"""quillon: ontology and vocabulary assessment over Spark DataFrames."""
