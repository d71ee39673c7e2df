"""Table registry, loaders, sinks and the demo generator."""

from dialweave.sources.schema import SET_NULL_RULES, TABLES, conform, evolve, redact  # noqa: F401
from dialweave.sources.seed import generate_calls  # noqa: F401
from dialweave.sources.sinks import append, latest_version, load_snapshot, manifest, publish, write_table  # noqa: F401
from dialweave.sources.tables import Tables, jdbc_options, load_tables, read_jdbc  # noqa: F401
