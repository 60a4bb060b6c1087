"""Every query of the engine over the driver's tables, with equivalent SQL where there is one."""

from __future__ import annotations

from prismlake.plans import image_queries, learning_queries, retrieval_queries, table_queries

QUERIES, ORACLES = {}, {}
for _module in (retrieval_queries, table_queries, image_queries, learning_queries):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
