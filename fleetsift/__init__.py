"""fleetsift: security audits of whole repository fleets as Spark jobs."""

__version__ = "0.1.0"
