"""Feature pipelines, training data, model monitoring and text preparation as Spark jobs."""
