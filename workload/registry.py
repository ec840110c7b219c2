"""All registered queries with their equivalent SQL, where there is one."""

from __future__ import annotations

from workload import catalogue, clusters, ingest, retrieval, schemas, search, streams

MODULES = [ingest, streams, catalogue, search, retrieval, clusters, schemas]


def entries() -> dict:
    out: dict = {}
    for module in MODULES:
        clash = out.keys() & module.ENTRIES.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(module.ENTRIES)
    return out
