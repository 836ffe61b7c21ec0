"""See the package README."""

from . import registry, layouts, summaries, library, measures, scoring, detection  # noqa: F401, I001  (the others add their queries to the registry)
