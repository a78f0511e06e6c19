"""A document retrieval and answer-grounding engine on Spark DataFrames."""
