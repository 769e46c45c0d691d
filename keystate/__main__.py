"""python -m keystate FOLDER get KEY | put KEY VALUE | delete KEY | batch-get KEY... | batch-put KEY=VALUE... | scan [START [END [LIMIT]]] | flush | compact"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .engine import KeyState
from .schema import KeyStateError


def run(store: KeyState, command: str, args: list[str]) -> list[str]:
    """The lines that a command prints."""
    raw = [a.encode() for a in args]
    if command == "get":
        value, found = store.get(raw[0])
        return [value.decode(errors="replace") if found else "(not found)"]
    if command in ("put", "set"):
        store.put(raw[0], raw[1])
    elif command in ("delete", "del"):
        store.delete(raw[0])
    elif command == "batch-get":
        return [f"{k.decode(errors='replace')}\t{v.decode(errors='replace') if found else '(not found)'}" for k, v, found in store.batch_get(raw)]
    elif command == "batch-put":
        store.batch_put([tuple(a.split(b"=", 1)) for a in raw])
    elif command == "scan":
        rows = store.scan(raw[0] if raw else None, raw[1] if len(raw) > 1 else None, int(args[2]) if len(args) > 2 else 0)
        return [f"{bytes(r['key']).decode(errors='replace')}\t{bytes(r['value'] or b'').decode(errors='replace')}" for r in rows.toLocalIterator()]
    elif command == "flush":
        store.flush()
    elif command == "compact":
        return [f"{store.compact()} merges"]
    else:
        raise KeyStateError(f"unknown command {command}")
    return ["OK"]


def main(argv: list[str]) -> int:
    if len(argv) < 2:
        print(__doc__)
        return 2
    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        print("\n".join(run(KeyState(spark, argv[0]), argv[1], argv[2:])))
        return 0
    except (KeyStateError, IndexError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
