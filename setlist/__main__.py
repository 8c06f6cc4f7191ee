"""Commands (O01-O05): ``python -m setlist run|ingest|curate|build-deck`` and ``registry show|validate|mark-printed``."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from .operators import registry
from .operators.ledger import Ledger
from .plans.jobs import Jobs, Settings
from .sources import playlists, runs
from .sources.snapshots import Table


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="setlist", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)

    def common(p: argparse.ArgumentParser) -> None:
        p.add_argument("--config", required=True, help="owners and deck sizes, JSON")
        p.add_argument("--runs", required=True, help="folder of all runs, in a store that the cluster shares")
        p.add_argument("--store", required=True, help="folder of what runs share: catalogs, corrections, registry")

    for name in ("ingest", "curate", "build-deck", "run"):
        p = commands.add_parser(name)
        common(p)
        p.add_argument("--raw", required=True, help="landed playlists")
        p.add_argument("--run-id", help="default: a new run for ingest and run, the last one otherwise")
        p.add_argument("--seed", type=int, default=666)
        p.add_argument("--as-of-year", type=int, default=None)
        p.add_argument("--review", help="reviewed sheet, CSV or XLSX")
        p.add_argument("--fetcher", help="import path of the year lookup")
        p.add_argument("--version", required=name in ("build-deck", "run"), default="", help="label of the print batch")
        p.add_argument("--print-scope", choices=("new-only", "all"), default="new-only")
        p.add_argument("--render-split", choices=("combined", "per-expansion", "both"), default="combined")
        p.add_argument("--discard-pending", action="store_true")
        p.add_argument("--mirror", help="a second place for the deck's files")
    p = commands.add_parser("registry")
    p.add_argument("what", choices=("show", "validate", "mark-printed"))
    common(p)
    p.add_argument("--version", default=None)
    return out


def _registry(spark: SparkSession, args: argparse.Namespace) -> int:
    book = Ledger(spark, f"{args.store}/registry")
    if book.table.version() is None:
        print("the registry is empty")
        return 0
    cards = book.read()
    if args.what == "show":
        rows = registry.show(cards).collect()
        print(f"{sum(r['cards'] for r in rows if r['expansion_anchor'] is not None and r['printed_status'] is None)} cards")
        for r in sorted((r for r in rows if r["printed_status"] is not None and r["expansion_anchor"] is not None), key=tuple):
            print(f"{r['expansion_anchor']}: {r['cards']} {r['printed_status']}")
        return 0
    if args.what == "validate":
        issues = [f"{r['rule']}: {r['n_rows']} rows" for r in registry.violations(cards).where("n_rows > 0").collect()]
        issues += [f"append {r['append']}, block {r['block']}: {r['why']}" for r in book.verify().collect()]
        songs = Table(spark, f"{args.store}/song_catalog")
        if songs.version() is not None and (lost := registry.drift(cards, songs.read()).count()):
            issues.append(f"identity drift: {lost} registered songs are not in the catalog")
        print("\n".join(issues) or f"the registry is valid: {cards.count()} cards")
        return 1 if issues else 0
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    after = registry.mark_printed(cards, args.version, now)
    marked = registry.change_counts(cards, after).first()["n_printed"]
    if marked:
        book.update(after)
    print(f"marked {marked} cards as printed")
    return 0


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("setlist").getOrCreate()
    if args.command == "registry":
        return _registry(spark, args)
    config = playlists.Config.load(args.config)
    now = datetime.now(timezone.utc)
    fresh = args.command in ("ingest", "run")
    run_id = args.run_id or (runs.run_id(now, args.seed) if fresh else runs.latest(spark, args.runs))
    if run_id is None:
        raise FileNotFoundError(f"{args.runs} has no run: ingest first")
    runs.create(spark, args.runs, run_id)
    runs.write_manifest(spark, args.runs, run_id, args.config, config.owners, args.seed, now)
    # the clock of a run is the one it began with, so a run that goes on asks the same questions
    began = runs.manifest(spark, args.runs, run_id)["created_at"]
    settings = Settings(
        run_id=run_id, root=args.runs, store=args.store, raw=args.raw, config=config, now=began, as_of_year=args.as_of_year or int(began[:4]), version=args.version, sheet=args.review,
        fetcher=args.fetcher, print_scope=args.print_scope, split=args.render_split, discard_pending=args.discard_pending, mirror=args.mirror,
    )
    jobs = Jobs(spark, settings)
    steps = {"ingest": jobs.ingest, "curate": jobs.curate, "build-deck": jobs.build_deck, "run": jobs.steps}[args.command]()
    done = jobs.run(steps)
    print(f"run {run_id}: {', '.join(done) or 'nothing to do'}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
