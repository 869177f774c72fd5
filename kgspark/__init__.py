"""A knowledge-graph retrieval and analytics engine on Spark DataFrames."""
