"""Job options and the fixed default values."""

from dataclasses import dataclass

# Default path rules.
DEFAULT_INCLUDE = (
    "src/**/*.cpp",
    "src/**/*.h",
    "src/**/*.hpp",
    "include/**/*.h",
    "include/**/*.hpp",
)
DEFAULT_EXCLUDE = (
    "**/test/**",
    "**/tests/**",
    "**/vendor/**",
    "**/third_party/**",
    "**/build/**",
)

# File suffixes of C and C++ sources.
CPP_SUFFIXES = (".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".hxx")

# Bytes that one aggregation builds a list or text from at once. Larger groups are ordered
# in parts of this many bytes, which join to the same text.
PART_BYTES = 64 << 20


@dataclass(frozen=True)
class JobOptions:
    """What a run needs besides its input tables."""

    include: tuple = DEFAULT_INCLUDE
    exclude: tuple = DEFAULT_EXCLUDE
    strategy: str = "directory"
    depth: int = 2
    mode: str = "incremental"  # or "full"
    scope: str = "changed"  # or "module": all files of affected modules
    part_bytes: int = PART_BYTES
    registry: object = None  # an extractors.Registry; C and C++ alone if missing
