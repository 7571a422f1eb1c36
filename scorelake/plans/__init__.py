"""The query catalogue; importing it registers the queries of all its modules."""

from scorelake.plans import catalogue, reports, readers  # noqa: F401, I001
