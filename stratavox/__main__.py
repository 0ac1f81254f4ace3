"""spark-submit entry point: python -m stratavox QUERY SF_DIR [OUT]. Without OUT, shows the first rows."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from stratavox.plans import registry


def main(args: list[str]) -> int:
    known = registry.queries()
    if len(args) not in (2, 3) or args[0] not in known:
        print(f"{__doc__}\n\nQueries: {', '.join(sorted(known))}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName(f"stratavox {args[0]}").getOrCreate()
    rows = known[args[0]](spark, args[1])
    if len(args) == 3:
        rows.write.parquet(args[2])
    else:
        rows.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
