"""Composed queries over the driver's tables."""

from strataquill.plans import files, graphs, registry, reports, retrieval, risks, small

__all__ = ["files", "graphs", "registry", "reports", "retrieval", "risks", "small"]
