"""Command line: ingest one event, replay a file, verify a stored ledger."""

from __future__ import annotations

import argparse
import uuid
from datetime import datetime, timezone

from tidegauge import api
from tidegauge.functions.normalize import normalize
from tidegauge.operators import ledger, ledger_store, replay, spatial
from tidegauge.session import session
from tidegauge.sources.telemetry import from_events


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest")
    one.add_argument("--sensor", required=True)
    one.add_argument("--timestamp")
    for name in ("ph", "turbidity", "conductivity", "temperature"):
        one.add_argument(f"--{name}", type=float)
    one.add_argument("--source", default="field")
    many = commands.add_parser("replay")
    many.add_argument("--fixture", required=True)
    many.add_argument("--strategy", default="source_priority")
    many.add_argument("--shuffle", action="store_true")
    many.add_argument("--verify", action="store_true")
    many.add_argument("--persist", help="folder of a ledger that goes on with this replay")
    many.add_argument("--batch", help="id of the replay; one that the ledger has is not added again")
    check = commands.add_parser("audit-verify")
    check.add_argument("--ledger", required=True)
    args = parser.parse_args(argv)
    spark = session("tidegauge-cli")

    if args.command == "ingest":
        named = {"pH": args.ph, "turbidity": args.turbidity, "conductivity": args.conductivity, "temperature": args.temperature}
        event = {"sensor_id": args.sensor, "timestamp": args.timestamp or datetime.now(timezone.utc).isoformat(), "readings": {k: v for k, v in named.items() if v is not None}, "source": args.source}
        api.ingest(from_events(spark, [event]), topo=spatial.topology(spark)).select("sensor_id", "status", "anomaly_type", "severity", "anomaly_score", "explanation", "fingerprint").show(truncate=False, vertical=True)
    elif args.command == "replay":
        try:
            events = normalize(api.load_fixture(spark, args.fixture))[0]
        except FileNotFoundError:
            print(f"no such file: {args.fixture}")
            return 2
        summary, states = replay.replay(spark, events, args.strategy, 42 if args.shuffle else None)
        summary.show()
        states.select("sensor_id", "version", "last_event_time", "readings").orderBy("sensor_id").show(truncate=False)
        if args.verify:
            print(replay.verify_order_invariance(events, args.strategy))
        if args.persist:
            added = ledger_store.append(ledger.bodies(replay.process(events, args.strategy)), args.persist, args.batch or uuid.uuid4().hex)
            print("ledger continued" if added else "the ledger has this batch")
    else:
        intact, fault = ledger_store.verify(spark, args.ledger)
        print("intact" if intact else f"not intact: {fault}")
        return int(not intact)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
