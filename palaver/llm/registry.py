"""The queries of this subpackage."""

from __future__ import annotations

from ..queries import gather

MODULES = ["same_text", "link_names", "turns", "sentences", "languages", "pii", "shared_spans", "packing", "mixing"]
QUERIES, SQL = gather(MODULES, __package__)
