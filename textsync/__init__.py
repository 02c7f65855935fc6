"""Text/timeline alignment as Spark jobs over tables keyed by book."""
