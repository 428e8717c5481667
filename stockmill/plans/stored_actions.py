"""Proposals, transfers, orders and the overstock list as stored tables, kept up to date.

They are made from stored tables alone: the gold summary and alerts, the bronze items and demand, and
the stock positions that ``store_positions`` keeps.  The proposal log only grows, by proposals
it does not hold yet.  Transfer requests and emergency orders are made anew when positions or
date have changed.  Of the overstock list, only months whose alerts or entries changed
are written.
"""

from pyspark.sql import functions as F

from stockmill.operators import actions, gold, sinks, versions
from stockmill.operators.transfers import transfer_plan
from stockmill.plans import incremental
from stockmill.schemas import FEEDS, ORDER_PROPOSALS, OVERSTOCK_ENTRIES, STOCK_POSITION, conform
from stockmill.session import exists

POSITIONS, ENTRIES = "stock_position", "overstock_entries"
TRANSFERS, ORDERS, OVERSTOCK = "transfer_requests", "emergency_orders", "all_overstock"
PROPOSALS = "order_proposals"


def store_positions(spark, out, positions):
    """Replace the stored stock positions."""
    return versions.write(conform(positions, STOCK_POSITION), f"{out}/gold/{POSITIONS}",
                          layer="gold")


def store_entries(spark, out, entries):
    """Replace the stored hand-entered overstock rows."""
    return versions.write(conform(entries, OVERSTOCK_ENTRIES), f"{out}/gold/{ENTRIES}", "month",
                          layer="gold")


def _bronze(spark, out, feed):
    rows = spark.read.schema(FEEDS[feed]).parquet(f"{out}/bronze/{feed}")
    return rows.select(*FEEDS[feed].names)


def _of_parts(spark, path, parts, schema=None):
    """Rows of some parts; none where ``schema`` is given and the table has no version yet."""
    found = versions.manifest(spark, path)
    if schema is not None and not found["version"]:
        return spark.createDataFrame([], schema)
    return versions.read(spark, path, parts=[p for p in parts if p in found["parts"]])


def add_proposals(spark, out):
    """Add the proposals that the log does not hold; returns the whole log.

    The id is made of item and month, so a run that is repeated adds nothing twice.
    """
    path = f"{out}/gold/{PROPOSALS}"
    new = actions.order_proposals(
        incremental.read_gold(spark, out, "inventory_summary"),
        versions.read(spark, f"{out}/gold/{POSITIONS}"),
        _bronze(spark, out, "item_master"), _bronze(spark, out, "demand"))
    if exists(spark, path):
        new = new.join(spark.read.schema(ORDER_PROPOSALS).parquet(path).select("proposal_id"),
                       "proposal_id", "left_anti")
    return sinks.append_order_proposals(new, path)


def make_requests(spark, out, request_date):
    """Transfer requests and emergency orders of the stored positions; False if up to date."""
    source = f"{out}/gold/{POSITIONS}"
    state = f"{versions.manifest(spark, source)['version']} {request_date}"
    positions = versions.read(spark, source)
    made = False
    for name, rows in (
            (TRANSFERS, lambda: actions.transfer_requests(
                transfer_plan(positions), request_date)),
            (ORDERS, lambda: actions.emergency_order_requests(positions, request_date))):
        path = f"{out}/gold/{name}"
        base = versions.manifest(spark, path)
        if base["notes"].get("made_of") != state:
            versions.write(rows(), path, base=base, layer="gold", notes={"made_of": state})
            made = True
    return made


def update_overstock(spark, out):
    """Write the months of the overstock list whose alerts or entries changed; returns them."""
    sources = [f"{out}/gold/{name}" for name in ("overstock_alert", ENTRIES)]
    parts = [versions.manifest(spark, s)["parts"] for s in sources]
    made_of = {p: " ".join(held[p]["folder"] if p in held else "-" for held in parts)
               for p in set().union(*parts)}
    path = f"{out}/gold/{OVERSTOCK}"
    base = versions.manifest(spark, path)
    done = base["notes"].get("made_of", {})
    touched = sorted(p for p in made_of.keys() | done.keys() if done.get(p) != made_of.get(p))
    if touched or not base["version"]:
        alerts = _of_parts(spark, sources[0], touched)
        entries = _of_parts(spark, sources[1], touched, OVERSTOCK_ENTRIES)
        rows = gold.all_overstock(alerts, entries)
        versions.write(rows, path, "month", touched, base, "gold", notes={"made_of": made_of})
    return touched


def update_actions(spark, out, request_date):
    """Bring all action tables up to date; returns them by name."""
    add_proposals(spark, out)
    make_requests(spark, out, request_date)
    update_overstock(spark, out)
    return action_tables(spark, out)


def action_tables(spark, out):
    found = {name: versions.read(spark, f"{out}/gold/{name}")
             for name in (TRANSFERS, ORDERS, OVERSTOCK)}
    found[PROPOSALS] = spark.read.schema(ORDER_PROPOSALS).parquet(f"{out}/gold/{PROPOSALS}")
    return found
