"""``python -m slotframe RANGE --data DIR [--with NAME]... [--sink PATH] [--resume] [--sequential] [--reverse] [--list]``."""

from __future__ import annotations

import argparse

from .plans.engine import REGISTRY, Engine, archive_streams, fixture_streams
from .session import local_session


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="slotframe")
    p.add_argument("range", nargs="?", help="epoch, a-b (epochs), a:b (slots), a..b or a..=b (epochs)")
    p.add_argument("--data", help="folder of the tables")
    group = p.add_mutually_exclusive_group()
    group.add_argument("--with", dest="names", action="append", choices=sorted(REGISTRY), help="analysis, repeatable")
    group.add_argument("--none", action="store_true", help="run no analysis")
    p.add_argument("--sink", help="folder to merge rows into")
    p.add_argument("--archive", help="folder of archived streams, as plans.engine.write_streams leaves them, instead of --data")
    p.add_argument("--resume", action="store_true", help="skip slots that the sink's progress names")
    p.add_argument("--sequential", action="store_true", help="one epoch after the other; needs --sink")
    p.add_argument("--reverse", action="store_true", help="the newest epoch first; needs --sink")
    p.add_argument("--list", action="store_true", help="list analyses")
    a = p.parse_args(argv)
    if a.list:
        print(*sorted(REGISTRY), sep="\n")
        return 0
    if not a.range or bool(a.data) == bool(a.archive):
        p.error("RANGE and one of --data and --archive are needed")
    if (a.sequential or a.reverse or a.resume) and not a.sink:
        p.error("--sequential, --reverse and --resume need --sink")
    spark = local_session()
    engine = Engine(spark).with_range(a.range).with_sink(a.sink)
    for name in [] if a.none else a.names or ["program-tracking"]:
        engine.with_analysis(name)
    if a.resume:
        engine.resumed()
    if a.reverse:
        engine.reversed()
    if a.archive:
        names = sorted({s for x in engine.analyses for s in x.streams})
        streams = archive_streams(spark, a.archive, *engine.slots, names=names)
    else:
        streams = fixture_streams(spark, a.data)
    run = engine.run_by_epoch if a.sequential or a.reverse else engine.run
    for name, rows in run(streams).items():
        print(name, rows.count())
    for name, why in engine.failures.items():
        print(name, "failed:", why)
    return int(bool(engine.failures))


if __name__ == "__main__":
    raise SystemExit(main())
