"""tidemark: event-signal analytics and corpus preparation as Spark DataFrames."""
