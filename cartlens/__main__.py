"""Command line, to be started with spark-submit or python -m cartlens.

  reports  --sales TABLE --out DIR [--name NAME ...]   write reports as CSV
  backfill --landing DIR --sales TABLE --start D --end D [--published]
  daily    --landing DIR --sales TABLE [--day D]
  stream   --landing DIR --sales TABLE --checkpoint DIR [--status DIR]
  verify   --sales TABLE                                day range and rows per day
  snapshot --sales TABLE --out DIR
  export   --snapshot DOCUMENT --out DIR

A table begun with --published changes all days of a load at once and keeps totals for each day, from which reports start;
it is recognised afterwards. vacuum --sales TABLE deletes what its last versions no longer name.

reports and snapshot take every field of Params as --param NAME=VALUE, such as
--param "xyz_cuts=(50, 80)" or --param segment_language=en.
"""

from __future__ import annotations

import argparse
import ast
from dataclasses import fields
from datetime import date

from cartlens import Params
from cartlens.operators.maintained import MaintainedSales, maintained_table
from cartlens.operators.shared import SharedSales
from cartlens.plans.catalog import REPORTS, report
from cartlens.session import build_session
from cartlens.sources.landing import backfill, load_day
from cartlens.sources.published import PublishedSales
from cartlens.sources.sales import load_range, read_sales, rows_per_day
from cartlens.sources.snapshot import export_csv, write_csv, write_snapshot
from cartlens.streaming.daily import start_daily_ingest


def parse(argv=None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="cartlens", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(dest="command", required=True)
    wanted = {
        "reports": ("sales", "out"),
        "backfill": ("landing", "sales", "start", "end"),
        "daily": ("landing", "sales"),
        "stream": ("landing", "sales", "checkpoint"),
        "verify": ("sales",),
        "vacuum": ("sales",),
        "snapshot": ("sales", "out"),
        "export": ("snapshot", "out"),
    }
    for name, required in wanted.items():
        command = commands.add_parser(name)
        for option in required:
            kind = date.fromisoformat if option in ("start", "end") else str
            command.add_argument(f"--{option}", required=True, type=kind)
        if name in ("reports", "snapshot", "verify"):
            command.add_argument("--from", dest="period_start", type=date.fromisoformat)
            command.add_argument("--until", dest="period_end", type=date.fromisoformat)
        if name in ("reports", "snapshot"):
            command.add_argument("--param", action="append", type=param, default=[], metavar="NAME=VALUE")
        if name == "reports":
            command.add_argument("--name", nargs="*", choices=sorted(REPORTS))
        if name in ("backfill", "daily", "stream"):
            command.add_argument("--array", action="store_true", help="files hold one JSON array each")
            command.add_argument("--quarantine")
            command.add_argument("--published", action="store_true", help="begin the table as a published one")
        if name == "vacuum":
            command.add_argument("--keep", type=int, default=2, help="versions that stay readable")
            command.add_argument("--hours", type=float, default=24, help="age from which unnamed loads go")
        if name == "daily":
            command.add_argument("--day", type=date.fromisoformat)
        if name == "stream":
            command.add_argument("--status")
    return parser.parse_args(argv)


def param(text: str) -> tuple:
    """Name and value of one field of Params."""
    name, _, value = text.partition("=")
    kinds = {f.name: type(f.default) for f in fields(Params)}
    if name not in kinds:
        raise argparse.ArgumentTypeError(f"unknown parameter {name!r}; known: {', '.join(kinds)}")
    if kinds[name] is date:
        return name, date.fromisoformat(value)
    return name, value if kinds[name] is str else ast.literal_eval(value)


def show(rows) -> None:
    """Print a result with one row per day at most."""
    print(*rows.columns, sep="\t")
    for row in rows.toLocalIterator():
        print(*row, sep="\t")


def batch(spark, table) -> SharedSales:
    """Sales for many reports: from the totals of a published table, or from the rows of another."""
    return SharedSales(read_sales(spark, table)) if isinstance(table, str) else MaintainedSales(table)


def run(args: argparse.Namespace, spark) -> None:
    period = dict(getattr(args, "param", []))
    if getattr(args, "period_start", None):
        period["start"] = args.period_start
    if getattr(args, "period_end", None):
        period["end"] = args.period_end
    p = Params(**period)
    table = getattr(args, "sales", None)
    if table and (getattr(args, "published", False) or PublishedSales.exists(spark, table)):
        table = maintained_table(spark, table)
    if args.command == "reports":
        with batch(spark, table) as sales:
            for name in args.name or sorted(REPORTS):
                write_csv(report(name, sales, p), f"{args.out}/{name}")
    elif args.command == "vacuum":
        if isinstance(table, str):
            raise SystemExit(f"{table} is not a published table")
        print(*table.vacuum(args.keep, args.hours), sep="\n")
    elif args.command == "backfill":
        show(backfill(spark, args.landing, table, args.start, args.end, args.array, args.quarantine))
    elif args.command == "daily":
        show(
            load_day(spark, args.landing, table, args.day, array=args.array, quarantine=args.quarantine)
        )
    elif args.command == "stream":
        start_daily_ingest(
            spark, args.landing, table, args.checkpoint, args.status, args.array, args.quarantine
        ).awaitTermination()
    elif args.command == "verify":
        if isinstance(table, str):
            sales = read_sales(spark, table)
            show(load_range(sales))
            show(rows_per_day(sales, p.start, p.end))
        else:
            show(table.load_range())
            show(table.rows_per_day(p.start, p.end))
    elif args.command == "snapshot":
        with batch(spark, table) as sales:
            write_snapshot(sales, p, args.out)
    elif args.command == "export":
        export_csv(spark, args.snapshot, args.out)


if __name__ == "__main__":
    run(parse(), build_session())
