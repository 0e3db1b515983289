"""palaver: knowledge retrieval over conversational text, on Spark DataFrames."""
