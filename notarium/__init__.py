"""notarium: search and analytics over Markdown note collections, on Spark."""
