"""python -m craterloom list | show NAME DIR [N] | export NAME DIR OUT [csv|json|parquet]

Exit codes: 0, 1 if a query fails, 2 if there is no such query or no data.
"""

from __future__ import annotations

import os
import sys


def main(args: list[str]) -> int:
    from craterloom.plans import catalog_all as engine

    if args[:1] == ["list"]:
        for name in engine.QUERIES:
            print(f"{name}\t{engine.COVERS[name]}")
        return 0
    if len(args) < 3 or args[0] not in ("show", "export"):
        print(__doc__)
        return 2
    name, data = args[1:3]
    if name not in engine.QUERIES or ("://" not in data and not os.path.isdir(data)):
        print(f"no such query or folder: {name} {data}", file=sys.stderr)
        return 2
    from pyspark.sql import SparkSession

    from craterloom.sources import sinks

    spark = SparkSession.builder.appName(f"craterloom {name}").getOrCreate()
    try:
        df = engine.QUERIES[name](spark, data)
        if args[0] == "show":
            df.show(int(args[3]) if len(args) > 3 else 20, truncate=False)
        else:
            kind = args[4] if len(args) > 4 else "parquet"
            {"csv": sinks.write_csv, "json": sinks.write_json, "parquet": lambda d, p: d.write.parquet(p)}[kind](df, args[3])
    except Exception as e:  # noqa: BLE001
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
