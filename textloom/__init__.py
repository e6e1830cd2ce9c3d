"""Text, retrieval and link-graph analytics as ordinary Spark jobs."""
