"""Commands over an archive: python -m tidemark.cli COMMAND ROOT ..."""

from __future__ import annotations

import argparse
import json
import shutil
import sys
import time
from pathlib import Path

from tidemark.plans.archive import Archive
from tidemark.session import local_session
from tidemark.sources.hot import read_hot


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: str, **flags):
        s = sub.add_parser(name)
        s.add_argument("root")
        for a in args:
            s.add_argument(a)
        for flag, kind in flags.items():
            s.add_argument(f"--{flag.replace('_', '-')}", **({"action": "store_true"} if kind is bool else {"type": kind}))

    add("seal", "hot", table=str, max_rows=int)
    add("find", "key")
    add("find-cold", "key")
    add("asof", ts=int, seq=int, window_ms=int, window_seq=int)
    for name in ("verify", "status", "check", "merge", "migrate"):
        add(name)
    add("ship", "relay", blobs=bool)
    add("p2p-sync", "peer")
    add("forget", "files")
    add("gc", relay=str, apply=bool)
    add("coldg")
    add("repair", "relay")
    add("restore-from-cold", "target")
    return p


def run(spark, a: argparse.Namespace) -> tuple[list[dict], int]:
    """Rows to print and the exit code."""
    archive = Archive(spark, a.root)
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    if a.command == "seal":
        return [archive.seal(read_hot(spark, a.hot, a.table or "log", int(time.time() * 1000)), a.max_rows)], 0
    if a.command in ("find", "find-cold"):
        found = rows(archive.find(a.key) if a.command == "find" else archive.find_cold(a.key))
        return found, 0 if found else 1
    if a.command == "asof":
        at = {k: getattr(a, k) for k in ("ts", "seq", "window_ms", "window_seq") if getattr(a, k) is not None}
        proof = archive.proof(**at).first().asDict()
        return [*rows(archive.as_of(**at).orderBy("seq", "id")), proof], 2 if proof["skipped_missing"] else 0
    if a.command == "verify":
        statuses, faults = (rows(x) for x in archive.verify())
        return statuses + faults, int(any(s["status"] != "OK" for s in statuses) or any(f["kind"] == "break" for f in faults))
    if a.command == "status":
        return rows(archive.status()), 0
    if a.command == "check":
        found = rows(archive.alerts(shutil.disk_usage(a.root if Path(a.root).is_dir() else "/").free >> 20))
        return found, {"ok": 0, "warn": 1, "critical": 2}[found[0]["level"]]
    if a.command == "merge":
        return [{"merged": archive.merge()}], 0
    if a.command == "migrate":
        return [archive.migrate()], 0
    if a.command == "ship":
        return [archive.ship(Archive(spark, a.relay), a.blobs)], 0
    if a.command == "p2p-sync":
        peer = Archive(spark, a.peer)
        return [{"pulled": peer.ship(archive, True), "pushed": archive.ship(peer, True)}], 0
    if a.command == "repair":
        done = archive.repair(Archive(spark, a.relay))
        return [done], int(done["left"] > 0)
    if a.command == "forget":
        archive.forget(a.files.split(","))
        return [], 0
    if a.command == "gc":
        return [archive.sweep(a.apply, Archive(spark, a.relay) if a.relay else None)], 0
    if a.command == "coldg":
        from tidemark.operators.lifecycle import cold_liveness

        return rows(cold_liveness(archive.cold, archive.chunks)), 0
    return [archive.restore(Archive(spark, a.target))], 0


def main(argv: list[str] | None = None) -> int:
    out, code = run(local_session(), parser().parse_args(argv))
    for row in out:
        print(json.dumps(row))
    return code


if __name__ == "__main__":
    sys.exit(main())
