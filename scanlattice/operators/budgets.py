"""Call budgets: admission, settlement, fences, lanes and holds, as a fold over events in order.

A refused reservation uses up nothing. The same step function serves a table (grouped by budget) and a
stream (state kept by budget), so both give the same outcomes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from decimal import ROUND_CEILING, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

OUT = "budget string, sequence long, outcome string, reserved_calls long, active long, observed_tokens long, fenced boolean"


@dataclass
class Policy:
    max_calls: int = 40
    input_limit: int = 1_500_000
    reservation: int = 100_000
    max_call_tokens: int = 250_000
    deadline: float = float("inf")
    native_percent: float | None = None
    cost_limit: int | None = None
    cost_reservation: int = 0


@dataclass
class State:
    """What a budget has given out. leases: lease -> lane or empty; holds: owner -> calls still held for it."""

    reserved: int = 0
    tokens: int = 0
    cost: int = 0
    fence: str = ""
    leases: dict = field(default_factory=dict)
    settled: list = field(default_factory=list)
    holds: dict = field(default_factory=dict)
    lanes: dict = field(default_factory=dict)


class Budget:
    def __init__(self, policy: Policy, state: dict | None = None):
        self.policy, self.state = policy, State(**state) if state else State()
        if state is None and policy.native_percent is not None:
            native = int(policy.max_calls * policy.native_percent / 100 + 0.5)
            share = {"native": (policy.native_percent > 0, native), "ai": (policy.native_percent < 100, policy.max_calls - native)}
            self.state.lanes = {n: {"enabled": on, "calls": calls, "used": 0, "complete": False} for n, (on, calls) in share.items()}

    def refusal(self, at: float, lane: str | None, owner: str | None) -> str:
        """Why no call may begin now; empty if one may."""
        p, s = self.policy, self.state
        held = sum(s.holds.values()) - (1 if s.holds.get(owner, 0) else 0)
        ahead = len(s.leases) + held + 1
        rules = [
            (bool(s.fence), s.fence), (at >= p.deadline, "deadline"), (s.reserved + held >= p.max_calls, "call_limit"),
            (p.cost_limit is not None and s.cost + ahead * p.cost_reservation > p.cost_limit, "cost_limit"), (s.tokens + ahead * p.reservation > p.input_limit, "input_limit"),
        ]
        if lane and s.lanes:
            own = s.lanes[lane]
            rules += [(not own["enabled"], "lane_disabled"), (own["complete"], "lane_complete"), (own["used"] >= own["calls"], "lane_share")]
        return next((why for hit, why in rules if hit), "")

    def step(self, e: dict) -> str:
        """The outcome of an event. finish and abandon without a lease are for the oldest open one."""
        s, op, owner, lane = self.state, e["op"], e.get("owner") or None, e.get("lane") or None
        if op in ("finish", "abandon") and not e.get("lease"):
            e = e | {"lease": next(iter(s.leases), None)}
        if lane and s.lanes and lane not in s.lanes:
            return "unknown_lane"
        if op == "reserve":
            why = self.refusal(e["at"], lane, owner)
            if why:
                return why
            s.reserved += 1
            s.leases[e["lease"]] = lane or ""
            if s.holds.get(owner, 0):
                s.holds[owner] -= 1
            if lane and s.lanes:
                s.lanes[lane]["used"] += 1
            return "admitted"
        if op == "finish":
            if e["lease"] not in s.leases:
                return "already_settled" if e["lease"] in s.settled else "unknown_lease"
            del s.leases[e["lease"]]
            s.settled.append(e["lease"])
            used = e.get("tokens")
            known = used is not None and used == used and used >= 0
            if known:
                s.tokens += int(used)
            cost = e.get("cost")
            if self.policy.cost_limit is not None:
                if cost is None or cost != cost:
                    s.fence = s.fence or "unknown_cost"
                else:
                    s.cost += int(cost)
            # Calls that run go on; only later ones are refused.
            if not known or used > self.policy.max_call_tokens:
                s.fence = s.fence or ("oversized_call" if known else "unknown_usage")
            return "settled" if known else "unknown"
        if op == "abandon":
            return "released" if s.leases.pop(e["lease"], None) is not None else "unknown_lease"
        if op == "hold":
            if owner in s.holds or s.lanes:
                return "refused_hold"
            s.holds[owner] = 0
            for _ in range(int(e["calls"])):
                if self.refusal(e["at"], None, None):
                    break
                s.holds[owner] += 1
            if not s.holds[owner]:
                del s.holds[owner]
                return "refused_hold"
            return f"held_{s.holds[owner]}"
        if op == "release":
            return "released" if s.holds.pop(owner, None) is not None else "no_hold"
        if op == "complete_lane":
            own = s.lanes.get(lane)
            other = s.lanes.get("ai" if lane == "native" else "native")
            if not own or own["complete"]:
                return "no_change"
            own["complete"] = True
            if other["enabled"] and not other["complete"]:
                spare = own["calls"] - own["used"]
                own["calls"], other["calls"] = own["used"], other["calls"] + spare
            return "lane_complete"
        return "unknown_operation"

    def row(self, budget: str, e: dict) -> tuple:
        outcome = self.step(e)
        return (budget, e["sequence"], outcome, self.state.reserved, len(self.state.leases), self.state.tokens, bool(self.state.fence))


_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def _events(rows: pd.DataFrame) -> list[dict]:
    return rows.sort_values("sequence", kind="stable").astype(object).where(rows.notna(), None).to_dict("records")


def fold(events: DataFrame, policy: Policy | None = None) -> DataFrame:
    """events(budget, sequence, at, op, lease, lane, owner, calls, tokens, cost) with the outcome of each.
    A budget's events are a sequence by their nature: its group has as many as it has calls."""
    policy = policy or Policy()

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one = Budget(policy)
        return pd.DataFrame([one.row(key[0], e) for e in _events(rows)], columns=_COLUMNS)

    return events.groupBy("budget").applyInPandas(run, OUT)


def stream(events: DataFrame, policy: Policy | None = None) -> DataFrame:
    """The same on a stream; the state of each budget is kept in the query's checkpoint, so a restart goes on."""
    policy = policy or Policy()

    def run(key, batches, state):
        one = Budget(policy, json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches))
        out = pd.DataFrame([one.row(key[0], e) for e in _events(rows)], columns=_COLUMNS)
        state.update((json.dumps(asdict(one.state)),))
        yield out

    return events.groupBy("budget").applyInPandasWithState(run, OUT, "state string", "append", "NoTimeout")


def rate(value) -> Decimal:
    """A price for a million tokens; ValueError unless finite and not negative."""
    try:
        out = Decimal(str(value))
    except InvalidOperation:
        raise ValueError(f"not a rate: {value!r}") from None
    if isinstance(value, bool) or not out.is_finite() or out < 0:
        raise ValueError(f"not a rate: {value!r}")
    return out


def reservation(rates: dict[str, str], input_tokens: int = 250_000, output_tokens: int = 16_000) -> int:
    """Micros that a call may cost at most by its limits."""
    most = max(rate(rates["input"]), rate(rates["cached"]))
    return int((input_tokens * most + output_tokens * rate(rates["output"])).to_integral_value(rounding=ROUND_CEILING))


def cost(rates: dict[str, str], total: Column, cached: Column, output: Column) -> Column:
    """Micros of a call at rates for a million tokens, rounded up once; null for unknown or impossible counts."""
    price = lambda k: F.lit(rate(rates[k])).cast("decimal(18,6)")
    n = lambda c: c.cast("decimal(18,0)")
    good = (total >= 0) & (output >= 0) & (cached >= 0) & (cached <= total)
    return F.when(good, F.ceil(n(total - cached) * price("input") + n(cached) * price("cached") + n(output) * price("output")).cast("long"))


def transferred(lanes: DataFrame) -> DataFrame:
    """lanes(budget, lane, allocation, used, complete, enabled) with the calls that complete lanes leave to the others."""
    spare = F.when(F.col("complete"), F.col("allocation") - F.col("used")).otherwise(0)
    own = lanes.select("budget", F.col("lane").alias("o_lane"), spare.alias("spare"))
    gained = lanes.join(own, "budget").where("lane != o_lane").groupBy("budget", "lane").agg(F.sum("spare").alias("gained"))
    out = lanes.join(gained, ["budget", "lane"], "left")
    open_ = F.col("enabled") & ~F.col("complete")
    return out.select("budget", "lane", F.when(F.col("complete"), F.col("used")).when(open_, F.col("allocation") + F.coalesce("gained", F.lit(0))).otherwise(F.col("allocation")).alias("allocation"))


def admitted(rows: DataFrame, key: str, order: str, amount: str, limit: int) -> DataFrame:
    """(key, order, admitted): rows in order while their sum stays within the limit; a refused row does not count, so
    a later one may still fit. Only these three columns go to a key's task."""
    fields = rows.select(key, order, amount).schema

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(order)
        total, out = 0, []
        for x in part[amount]:
            out.append(total + x <= limit)
            total += x if out[-1] else 0
        return part[[key, order]].assign(admitted=out)

    return rows.select(key, order, amount).groupBy(key).applyInPandas(run, f"`{key}` {fields[0].dataType.simpleString()}, `{order}` {fields[1].dataType.simpleString()}, admitted boolean")
