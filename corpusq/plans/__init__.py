"""Plan helpers: cutting lineage, connected components, whole pipelines."""
