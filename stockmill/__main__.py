"""Command line: ``spark-submit`` this file, or ``python -m stockmill``.

  generate --landing DIR [--items N] [--orders N] [--dry-run]
  update   --landing DIR --out DIR [--database NAME] [--buckets-in DATABASE]
  act      --out DIR [--positions CSV] [--date DAY]
  report   --out DIR
"""

import argparse
import datetime

from stockmill.operators import marts
from stockmill.plans import colocated, generate, incremental, medallion, stored_actions
from stockmill.schemas import STOCK_POSITION
from stockmill.session import build_session


def _generate(spark, args):
    feeds = generate.generated_feeds(spark, args.items, args.orders)
    for summary in generate.feed_summaries(feeds):
        summary.orderBy("category").show(truncate=False)
    if not args.dry_run:
        generate.generate_landing(spark, args.landing, args.items, args.orders)


def _update(spark, args):
    marks = {}
    for mark in args.watermark:
        table, column, delay = mark.split(":")
        marks[table] = (column, delay)
    medallion.run_pipeline(spark, args.out, args.landing, watermarks=marks)
    if args.database:
        medallion.register_layers(spark, args.out, args.database)
    if args.buckets_in:
        colocated.store_layers(spark, args.out, args.buckets_in)


def _act(spark, args):
    if args.positions:
        stored_actions.store_positions(spark, args.out, spark.read.schema(STOCK_POSITION).csv(
            args.positions, header=True, enforceSchema=False))
    found = stored_actions.update_actions(spark, args.out, args.date)
    for name, table in found.items():
        print(name, table.count())


def _report(spark, args):
    for table in medallion.health(spark, args.out):
        table.show()
    gold = {name: incremental.read_gold(spark, args.out, name) for name in medallion.GOLD}
    receipts = medallion.read_layer(spark, args.out, "silver", "receipts")
    marts.widget_counters(
        marts.inventory_kpi(gold["inventory_summary"]),
        marts.turnover_kpi(gold["turnover_analysis"]),
        marts.overstock_kpi(gold["overstock_alert"]),
    ).show()
    marts.category_breakdown(gold["inventory_summary"]).show()
    marts.overstock_alerts(gold["overstock_alert"]).show(truncate=False)
    marts.supplier_leadtime(receipts).show()


def main(argv=None, spark=None):
    parser = argparse.ArgumentParser(prog="stockmill")
    commands = parser.add_subparsers(dest="command", required=True)
    make = commands.add_parser("generate")
    make.add_argument("--landing", default=None)
    make.add_argument("--items", type=int, default=generate.ITEMS)
    make.add_argument("--orders", type=int, default=generate.ORDERS)
    make.add_argument("--dry-run", action="store_true")
    make.set_defaults(run=_generate)
    update = commands.add_parser("update")
    update.add_argument("--landing", default=None)
    update.add_argument("--out", required=True)
    update.add_argument("--database", default=None)
    update.add_argument("--watermark", action="append", default=[],
                        metavar="TABLE:COLUMN:DELAY", help="bounds the dedupe state of a table")
    update.set_defaults(run=_update)
    update.add_argument("--buckets-in", default=None, metavar="DATABASE",
                        help="also keep monthly tables bucketed by item, named in DATABASE")
    act = commands.add_parser("act")
    act.add_argument("--out", required=True)
    act.add_argument("--positions", default=None, help="CSV of stock positions to take over")
    act.add_argument("--date", default=datetime.date.today().isoformat())
    act.set_defaults(run=_act)
    report = commands.add_parser("report")
    report.add_argument("--out", required=True)
    report.set_defaults(run=_report)
    args = parser.parse_args(argv)
    if args.command == "generate" and not args.dry_run and not args.landing:
        parser.error("--landing is required unless --dry-run is given")
    args.run(spark or build_session(), args)


if __name__ == "__main__":
    main()
