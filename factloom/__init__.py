"""Facts about software systems as DataFrames: typed relations, their graph, and questions about it."""
