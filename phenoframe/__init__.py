"""phenoframe: profiling of per-object measurement tables as ordinary Spark jobs."""
