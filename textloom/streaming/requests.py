"""The keyed request protocol as a stateful stream: protect, repeat, restore, refuse.

Detection and masking run before, as plain columns; the state of a (system, payload_id) is one record that lives
`ttl_seconds` from its creation and isn't extended. Events of a key in one batch are taken by (ts, seq); batches are
answered as they arrive, so an earlier event that comes in a later batch meets the record that is there by then.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.functions.spans import TOKEN

OUT = "system string, payload_id string, seq long, outcome string, direction string, result string"
STATE = "original string, masked string, mode string, replacements string, expires long"


def _restore(payload: str, operation: str, record: tuple) -> tuple[str, str | None]:
    original_hash, masked, mode, replacements, _ = record
    known = json.loads(replacements)
    if payload == masked:
        out, at = [], 0
        for r in known:
            out += [masked[at : r["start"]], r["original"]]
            at = r["end"]
        return "restored", "".join([*out, masked[at:]])
    if operation == "unmask" and mode == "token":
        values = {r["replacement"]: r["original"] for r in known}
        tokens = re.findall(TOKEN, payload)
        if not tokens or any(t not in values for t in tokens):
            return "unknown_token", None
        return "restored", re.sub(TOKEN, lambda m: values[m.group()], payload)
    return "payload_conflict", None


def answer(operation: str, digest: str, payload: str, mode: str, record: tuple | None) -> tuple[str, str, str | None]:
    """outcome, direction and result of one request against the key's record."""
    if record is None:
        return ("mapping_expired", "unmask", None) if operation == "unmask" else ("created", "mask", None)
    if operation == "unmask" or (operation == "process" and payload == record[1] and digest != record[0]):
        outcome, result = _restore(payload, operation, record)
        return outcome, "unmask", result
    if digest != record[0]:
        return "payload_conflict", "mask", None
    if operation == "mask" and mode != record[2]:
        return "mode_conflict", "mask", None
    return "repeated", "mask", record[1]


def keyed_requests(requests: DataFrame, ttl_seconds: int = 900, late: str = "15 minutes") -> DataFrame:
    """requests (system, payload_id, seq, ts, operation, payload, mode, masked, replacements) as a stream of answers (OUT).

    masked and replacements are what replace_spans gives for the payload; null payloads are refused before.
    """
    millis = F.unix_millis("ts")
    rows = requests.where("payload is not null").withWatermark("ts", late).select("system", "payload_id", "seq", millis.alias("at"), "ts", "operation", "payload", "mode", "masked", F.to_json("replacements").alias("replacements"), F.sha2("payload", 256).alias("digest"))

    def serve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        record, out = (state.get if state.exists else None), []
        for row in pd.concat(list(batches)).sort_values(["at", "seq"]).itertuples():
            if record is not None and row.at >= record[4]:
                record = None
            outcome, direction, result = answer(row.operation, row.digest, row.payload, row.mode, record)
            if outcome == "created":
                record, result = (row.digest, row.masked, row.mode, row.replacements, int(row.at) + ttl_seconds * 1000), row.masked
            out.append((*key, row.seq, outcome, direction, result))
        if record is None:
            if state.exists:
                state.remove()
        else:
            state.update(record)
            state.setTimeoutTimestamp(max(record[4], state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["system", "payload_id", "seq", "outcome", "direction", "result"])

    return rows.groupBy("system", "payload_id").applyInPandasWithState(serve, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
