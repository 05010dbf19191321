"""State of the streaming rules (STF-1 to STF-5), one processor per rule.

State lives in Spark's state store (RocksDB), spread by the hash of its key, a
few numbers a key; it survives lost executors with the stream's checkpoint.
Rows of a key come unordered inside a micro-batch and are sorted there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pricelark.operators.stateful import ATTEMPTS_A_DAY, DISTINCT_VARIANTS, STRIKES

#: How long a day's count is kept after it was last changed.
DAY_MS = 24 * 60 * 60 * 1000
# Weights of strategies; any other has 1.
WEIGHTS = {"": 0, "Cloudflare": 3, "Heavy-JS": 2}


def _sorted(parts: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(parts)).sort_values(list(order), kind="stable")


class PriceChanges(StatefulProcessor):
    """STF-1: captures that differ from the one before. State: the last price and stock."""

    OUT = "variant_id int, price decimal(18,2), in_stock boolean, captured_at timestamp_ntz"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "price string, in_stock boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = _sorted(rows, "captured_at", "price")
        last = tuple(self.last.get()) if self.last.exists() else (None, None)
        keep = []
        for price, stock in zip(got["price"], got["in_stock"], strict=True):
            now = (str(price), bool(stock))
            keep.append(now != last)
            last = now
        self.last.update(last)
        yield got[keep][["variant_id", "price", "in_stock", "captured_at"]]

    def close(self) -> None:
        pass


class AttemptLimiter(StatefulProcessor):
    """STF-2: the first attempts of a variant's day are let through. State: a count per day, which expires a day after its last change."""

    OUT = "attempt_id long, variant_id long, attempted_at timestamp_ntz, attempts_today int, allowed boolean"

    def __init__(self, limit: int = ATTEMPTS_A_DAY, keep_ms: int = DAY_MS):
        self.limit, self.keep_ms = limit, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.days = handle.getMapState("days", "day string", "n int", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = _sorted(rows, "attempted_at", "attempt_id")
        counts, allowed = pd.Series(0, index=got.index, dtype="int32"), pd.Series(False, index=got.index)
        for day, part in got.groupby(got["attempted_at"].dt.strftime("%Y-%m-%d"), sort=False):
            had = self.days.getValue((day,))[0] if self.days.containsKey((day,)) else 0
            place = had + pd.Series(range(1, len(part) + 1), index=part.index)
            counts[part.index], allowed[part.index] = place.clip(upper=self.limit).astype("int32"), place <= self.limit
            self.days.updateValue((day,), (min(had + len(part), self.limit),))
        yield got.assign(attempts_today=counts, allowed=allowed)[["attempt_id", "variant_id", "attempted_at", "attempts_today", "allowed"]]

    def close(self) -> None:
        pass


class SelectorPromotion(StatefulProcessor):
    """STF-3: a site's selector, when the last variant that it needed confirms it. State: its variants so far, no more than it needs."""

    OUT = "site_id long, xpath string, validated_at timestamp_ntz"

    def __init__(self, needed: int = DISTINCT_VARIANTS):
        self.needed = needed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "variant_id long", "candidate_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = _sorted(rows, "validated_at", "candidate_id")
        known = {k[0] for k in self.known.keys()}
        keep = []
        for variant, price, candidate in zip(got["variant_id"], got["price"], got["candidate_id"], strict=True):
            fresh = price is not None and price > 0 and len(known) < self.needed and int(variant) not in known
            if fresh:
                known.add(int(variant))
                self.known.updateValue((int(variant),), (int(candidate),))
            keep.append(fresh and len(known) == self.needed)
        yield got[keep][["site_id", "xpath", "validated_at"]]

    def close(self) -> None:
        pass


class ProxyHealth(StatefulProcessor):
    """STF-4: failures in a row, ban, and the latency that a success sets. State: these three.

    A proxy that isn't heard of for `silent_ms` is forgotten by a timer (0:
    never), unless it is banned; a ban stays.
    """

    OUT = "result_id long, proxy_id long, tried_at timestamp_ntz, ok boolean, failures long, banned boolean, proxy_latency int"

    def __init__(self, strikes: int = STRIKES, unban: bool = False, silent_ms: int = 0):
        self.strikes, self.unban, self.silent_ms = strikes, unban, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.health = handle.getValueState("health", "failures long, banned boolean, latency int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = _sorted(rows, "tried_at", "result_id")
        n, banned, latency = tuple(self.health.get()) if self.health.exists() else (0, False, None)
        out = []
        taken = got["latency_ms"] if "latency_ms" in got else [None] * len(got)
        for ok, ms in zip(got["ok"], taken, strict=True):
            n = 0 if ok else n + 1
            if ok and ms is not None and not pd.isna(ms):
                latency = int(ms)
            banned = n >= self.strikes or bool(banned and not self.unban)
            out.append((n, banned, latency))
        self.health.update((n, banned, latency))
        if self.silent_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        found = pd.DataFrame(out, columns=["failures", "banned", "proxy_latency"], index=got.index)
        found["proxy_latency"] = found["proxy_latency"].astype("Int32")
        yield pd.concat([got[["result_id", "proxy_id", "tried_at", "ok"]], found], axis=1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.health.exists() and not self.health.get()[1]:
            self.health.clear()
        return iter(())

    def close(self) -> None:
        pass


class StrategyEscalation(StatefulProcessor):
    """STF-5: a site's strategy only gets stronger. State: the strategy."""

    OUT = "detection_id long, site_id long, detected_at timestamp_ntz, strategy string, current string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "strategy string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = _sorted(rows, "detected_at", "detection_id")
        now = self.now.get()[0] if self.now.exists() else ""
        current = []
        for s in got["strategy"]:
            if WEIGHTS.get(s, 1) > WEIGHTS.get(now, 1):
                now = s
            current.append(now)
        self.now.update((now,))
        yield got.assign(current=pd.Series(current, index=got.index, dtype=object))[["detection_id", "site_id", "detected_at", "strategy", "current"]]

    def close(self) -> None:
        pass
