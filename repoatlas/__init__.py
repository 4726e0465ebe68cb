"""repoatlas: code maps of many repositories as Spark jobs."""

__version__ = "0.1.0"
TOOL_NAME = "repoatlas"
