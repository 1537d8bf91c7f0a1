"""Requests against a keyed mapping table: policies, first writer wins, expiry, rate limits, chunks."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from textloom.types import MODES


def select_by_policy(spans: Column, types: Column, min_types: Column, required: Column, masking: Column) -> Column:
    """struct(selected, detected_types): allowed types only; nothing if too few or a required type is missing, or masking is off."""
    allowed = F.filter(spans, lambda s: (F.size(types) == 0) | F.array_contains(types, s["type"]))
    found = F.array_sort(F.array_distinct(F.transform(allowed, lambda s: s["type"])))
    enough = (F.size(found) >= min_types) & (F.size(F.array_except(required, found)) == 0) & masking
    return F.struct(F.when(enough, allowed).otherwise(F.filter(allowed, lambda s: F.lit(False))).alias("selected"), found.alias("detected_types"))


def first_writers(requests: DataFrame, key: list[str], order: list[str], digest: str, mode: str) -> DataFrame:
    """Requests with `outcome`: created, repeated, payload_conflict or mode_conflict against the key's first request."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = lambda c: F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0))
    outcome = F.when(F.row_number().over(w) == 1, "created").when(F.col(digest) != first(digest), "payload_conflict").when(F.col(mode) != first(mode), "mode_conflict").otherwise("repeated")
    return requests.withColumn("outcome", outcome)


def micros(at: str) -> Column:
    """Microseconds since 1970, whatever the session's time zone, of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({at} as timestamp_ntz))")


def _in_order(requests: DataFrame, key: str, at: str, order: str, new: str, fold: Callable) -> DataFrame:
    """requests with the columns `new` that fold gives row by row in the order of each key.

    Rows are sorted by key and time and pass through batch by batch, with the state of one key only: a hot key takes time,
    not memory. fold(state or None, microseconds) gives the next state and the row's values.
    """
    hidden = requests.withColumn("_k", F.col(key).cast("string")).withColumn("_t", micros(at))
    names, own = [c.split()[0] for c in new.split(",")], requests.columns
    schema = StructType([*requests.schema.fields, *StructType.fromDDL(new).fields])

    def run(batches):
        seen, state = None, None
        for batch in batches:
            out = []
            for k, t in zip(batch.column("_k").to_pylist(), batch.column("_t").to_pylist()):
                if k != seen:
                    seen, state = k, None
                state, values = fold(state, t)
                out.append(values)
            plain = batch.select(own)
            columns = [pa.array(list(c)) for c in zip(*out)] or [pa.array([])] * len(names)
            if out:
                yield pa.RecordBatch.from_arrays([*plain.columns, *columns], [*plain.schema.names, *names])

    return hidden.where("_k is not null and _t is not null").repartition("_k").sortWithinPartitions("_k", "_t", order).mapInArrow(run, schema)


def opened_at(requests: DataFrame, key: str, at: str, order: str, seconds: float, limit: int | None = None) -> DataFrame:
    """requests with `opened` (microseconds) of the window each falls into, its place `n` in it, and `accepted`: n is at most limit.

    A key's window opens at its first request, lasts `seconds` and isn't extended; the next request after it opens another.
    """
    width = int(seconds * 1_000_000)

    def fold(state, t):
        opened, n = state if state and t < state[0] + width else (t, 0)
        return (opened, n + 1), (opened, n + 1, limit is None or n < limit)

    return _in_order(requests, key, at, order, "opened long, n long, accepted boolean", fold)


def with_expiry(requests: DataFrame, key: str, at: str, ttl_seconds: int, order: str | None = None) -> DataFrame:
    """key, opened (microseconds), n: the lives of each key's records. A life lasts ttl_seconds from its first write, later writes don't extend it."""
    return opened_at(requests, key, at, order or at, ttl_seconds).groupBy(key, "opened").agg(F.count("*").alias("n"))


def token_bucket(requests: DataFrame, key: str, at: str, order: str, rate: float, capacity: float | None = None) -> DataFrame:
    """requests with `accepted` and `balance` left: a key's bucket holds `capacity` (rate) tokens at most and gains `rate` a second."""
    most = float(capacity or rate)

    def fold(state, t):
        left = most if state is None else min(most, state[0] + (t - state[1]) / 1_000_000 * rate)
        ok = left >= 1
        left -= ok
        return (left, t), (ok, left)

    return _in_order(requests, key, at, order, "accepted boolean, balance double", fold)


def rate_limited(requests: DataFrame, key: str, at: str, order: str, seconds: float, limit: int) -> DataFrame:
    """requests with `accepted`: at most `limit` in each window of a key; a window opens at the first request after the last one's end."""
    return opened_at(requests, key, at, order, seconds, limit)


def within_capacity(requests: DataFrame, key: list[str], order: list[str], most: int) -> DataFrame:
    """requests (with outcome of first_writers) where keys beyond the first `most` are vault_full; existing records stay. Order is numbered range by range, in no single task."""
    from textloom.operators.reports import numbered

    full = numbered(requests.where("outcome = 'created'").select(*key, *order), order, "_rank").where(F.col("_rank") > most).select(*key, F.lit(True).alias("_full"))
    return requests.join(full, key, "left").withColumn("outcome", F.when(F.col("_full"), "vault_full").otherwise(F.col("outcome"))).drop("_full")


def authorize(requests: DataFrame, policies: DataFrame) -> DataFrame:
    """requests (system, api_key) with `error`: access_denied for an unknown or disabled system, unauthorized for a wrong key. Only hashes of keys are compared."""
    known = policies.select("system", "enabled", "api_key_hash")
    joined = requests.join(known, "system", "left")
    allowed, right = F.coalesce("enabled", F.lit(False)), F.coalesce(F.sha2("api_key", 256) == F.col("api_key_hash"), F.lit(False))
    return joined.withColumn("error", F.when(~allowed, "access_denied").when(~right, "unauthorized")).drop("enabled", "api_key_hash")


def request_errors(requests: DataFrame, most: int = 2_000_000, modes: tuple[str, ...] = MODES) -> DataFrame:
    """requests (error, accepted, payload as bytes, mode, allowed_modes) with the first error in order: the one given, rate_limited, too_large, invalid_unicode, invalid_mode."""
    text = F.col("payload")
    size = F.when(F.is_valid_utf8(text.cast("string")), F.length(text.cast("string")))
    allowed = F.when(F.size("allowed_modes") > 0, F.col("allowed_modes")).otherwise(F.array(*map(F.lit, modes)))
    error = F.coalesce(
        F.col("error"), F.when(~F.coalesce("accepted", F.lit(True)), "rate_limited"), F.when(size > most, "too_large"), F.when(size.isNull(), "invalid_unicode"), F.when(F.col("mode").isNotNull() & ~F.array_contains(allowed, F.col("mode")), "invalid_mode")
    )
    return requests.withColumn("error", error)


def chunks(docs: DataFrame, size: int = 16000, overlap: int = 256) -> DataFrame:
    """doc_id, start, text of overlapping pieces; a text of up to `size` code points is one piece."""
    step = size - overlap
    last = F.greatest(F.ceil((F.length("text") - size) / step), F.lit(0)).cast("int")
    pieces = docs.where("text is not null").select("doc_id", "text", F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return pieces.select("doc_id", (F.col("i") * step).cast("long").alias("start"), F.substring(F.col("text"), F.col("i") * step + 1, F.lit(size)).alias("chunk"))


def seal(record: Column, key: Column, aad: Column) -> Column:
    """nonce and AES-GCM ciphertext of a JSON record bound to aad; Spark draws the nonce."""
    return F.aes_encrypt(record.cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), aad.cast("binary"))


def unseal(sealed: Column, key: Column, aad: Column) -> Column:
    """The JSON record, null if it was changed or bound to something else."""
    return F.try_aes_decrypt(sealed, key, F.lit("GCM"), F.lit("DEFAULT"), aad.cast("binary")).cast("string")
