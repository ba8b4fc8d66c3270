"""Streams of events: rate windows, idempotent intake, keyed lock-outs. Each has a batch counterpart in plans."""
