"""python -m riffle --sources s.yaml --rules r.yaml --pack p.yaml --landing DIR --store DIR --now 2024-01-10T12:00:00Z [--seed DOC] [--no-fetch]"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from riffle.domain import ConfigError
from riffle.operators.reports import AllFailed
from riffle.operators.store import Store
from riffle.plans import job
from riffle.session import builder


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="riffle", description=__doc__)
    for name in ("sources", "rules", "pack", "landing", "store", "now"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--seed", help="the document that a store without a history begins with")
    p.add_argument("--no-fetch", action="store_true", help="read what has landed")
    a = p.parse_args(argv)
    try:
        config = job.Config.load(a.sources, a.rules, a.pack)
    except ConfigError as e:
        print(f"configuration: {e}", file=sys.stderr)
        return 2
    spark = builder().getOrCreate()
    feeds = job.plan_feeds(config.sources, a.landing)
    if not a.no_fetch:
        for r in job.land(spark, feeds, a.landing, config.sources.limits.timeout_seconds).where("status <> 200").collect():
            print(f"status {r.status}: {r.url}", file=sys.stderr)
    now = F.to_timestamp(F.lit(a.now))
    try:
        published, funnel = job.run(spark, config, [x for _, x in feeds], Store(spark, a.store), now, on_error=lambda f, e: print(f"{f.source}: {e!s:.200}", file=sys.stderr), seed=a.seed)
    except AllFailed as e:
        print(e, file=sys.stderr)
        return 1
    funnel.orderBy("ord").show(truncate=False)
    print(f"{published.count()} rows published")
    return 0


if __name__ == "__main__":
    sys.exit(main())
