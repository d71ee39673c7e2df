"""Batch jobs that turn a change batch into new table contents.

Each returns the new table (or tables), the rejected input with reasons, and the
rows it wrote. Nothing is modified in place: publish the result as a snapshot.
"""

from dialweave.maintenance.changes import Change, accept_first, number_rows, positioned, stamp_entry  # noqa: F401
from dialweave.maintenance.deletes import Deleted, delete  # noqa: F401
from dialweave.maintenance.ingest import ingest, insert_ignore  # noqa: F401
from dialweave.maintenance.interactions import Applied, apply_interactions, bulk_assign  # noqa: F401
from dialweave.maintenance.quality import RULES, email_ok, orphans, validate  # noqa: F401
from dialweave.maintenance.updates import partial_update, set_status  # noqa: F401
