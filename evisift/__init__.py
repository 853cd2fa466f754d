"""evisift: evidence retrieval and question answering over long documents on Spark."""
