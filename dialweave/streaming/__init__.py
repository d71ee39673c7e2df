"""The interaction feed and live activity as Structured Streaming."""

from dialweave.streaming.activity import (  # noqa: F401
    fold_activity,
    prune_activity,
    start_activity,
    stored_activity,
)
from dialweave.streaming.interactions import (  # noqa: F401
    FEED_SCHEMA,
    current_assignments,
    fold_interactions,
    interaction_stream,
    prune_interactions,
    start_interactions,
    stored_history,
)
