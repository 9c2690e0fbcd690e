"""Content-addressed data on Spark: chunking, manifests, de-duplication, lifecycle and access as DataFrame plans."""
