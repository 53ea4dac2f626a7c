"""``python -m stratalode COMMAND STORE …``: inspection, checks and copies, as JSON.

Exit codes: 0 well, 1 failed, 2 wrong usage, 3 not found, 4 issues found.
"""

from __future__ import annotations

import argparse
import json
import sys

from stratalode import errors as E

JSON_VERSION = 1
NOT_FOUND = (E.NotStore, E.ObjectNotFound, E.ObjectChunkNotFound, E.VectorCollectionNotFound, E.VectorNotFound, E.GraphNotFound, E.GraphNodeNotFound, E.GraphEdgeNotFound)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="stratalode", description=__doc__.split("\n")[0])
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("create", "info", "stats", "tables", "objects", "chunks", "collections", "graphs", "check", "doctor", "vacuum", "salvage-plan"):
        c = sub.add_parser(name)
        c.add_argument("store")
        c.add_argument("--limit", type=int, default=10)
        c.add_argument("--deep", action="store_true")
    for name in ("object", "chunk", "vectors", "nodes"):
        c = sub.add_parser(name)
        c.add_argument("store")
        c.add_argument("key")
        c.add_argument("--limit", type=int, default=10)
    for name in ("neighbors", "walk"):
        c = sub.add_parser(name)
        c.add_argument("store")
        c.add_argument("node")
        c.add_argument("--graph", default="default")
        c.add_argument("--edge-type")
        c.add_argument("--limit", type=int, default=10)
        c.add_argument("--direction", default="outgoing")
        c.add_argument("--max-depth", type=int, default=1)
    for name in ("backup", "compact", "restore", "salvage"):
        c = sub.add_parser(name)
        c.add_argument("store")
        c.add_argument("destination")
    return p


def answer(spark, a: argparse.Namespace) -> tuple[dict, int]:
    from stratalode.functions.scalars import parse_hex_id
    from stratalode.sources.store import Store, restore

    if a.command == "create":
        return {"store_id": Store.create(spark, a.store).manifest["store_id"]}, 0
    if a.command == "restore":
        return restore(spark, a.store, a.destination).summary(), 0
    store = Store.open(spark, a.store, read_only=a.command != "vacuum")
    if a.command in ("check", "doctor"):
        found = store.check(a.deep, a.limit) if a.command == "check" else store.doctor(a.limit)
        return found, 0 if found["ok"] else 4
    listed = lambda df, n: {"items": [r.asDict() for r in df.limit(n + 1).collect()][:n]}
    if a.command in ("neighbors", "walk"):  # one row more than shown, to know whether more follow
        kw = {"graph_name": a.graph, "edge_type": a.edge_type, "limit": a.limit + 1}
        rows = store.graph_neighbors(a.node, direction=a.direction, **kw) if a.command == "neighbors" else store.graph_walk(a.node, max_depth=a.max_depth, **kw)
        rows = [r.asDict() for r in rows.orderBy("rank").collect()]
        return {"items": rows[: a.limit], "truncated": len(rows) > a.limit}, 0
    calls = {
        "info": lambda: {k: store.manifest[k] for k in ("store_id", "format_version", "role", "epoch")} | store.summary(),
        "stats": store.object_stats,
        "tables": lambda: {"items": store.user_tables()},
        "objects": lambda: store.list_objects(a.limit),
        "chunks": lambda: store.list_chunks(a.limit),
        "collections": lambda: listed(store.list_vector_collections(), a.limit),
        "graphs": lambda: listed(store.list_graphs(), a.limit),
        "salvage-plan": store.salvage_plan,
        "vacuum": lambda: store.vacuum() or {},
        "object": lambda: store.inspect_object(parse_hex_id(a.key), a.limit),
        "chunk": lambda: store.inspect_chunk(parse_hex_id(a.key), a.limit),
        "vectors": lambda: store.list_vectors(a.key, a.limit),
        "nodes": lambda: store.list_graph_nodes(a.key, a.limit),
        "backup": lambda: store.backup(a.destination).summary(),
        "compact": lambda: store.compact(a.destination).summary(),
        "salvage": lambda: store.salvage(a.destination).summary(),
    }
    return calls[a.command](), 0


def main(args: list[str], spark=None) -> int:
    try:
        a = parser().parse_args(args)
    except SystemExit as e:
        return 2 if e.code else 0
    if spark is None:
        from stratalode.session import local_session

        spark = local_session("stratalode-cli")
    try:
        found, code = answer(spark, a)
    except NOT_FOUND as e:
        found, code = {"error": type(e).__name__, "detail": str(e)}, 3
    except E.StoreError as e:
        found, code = {"error": type(e).__name__, "detail": str(e)}, 1
    print(json.dumps({"json_version": JSON_VERSION, "command": a.command, **found}, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
