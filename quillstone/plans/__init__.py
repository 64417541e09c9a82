"""Queries over the star-schema tables, each an operator applied to them. Importing this registers all."""

from quillstone.plans import aggregation, code, graphs, joining, ordering, scoring, services, sheets, text  # noqa: F401
