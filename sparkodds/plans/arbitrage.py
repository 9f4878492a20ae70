"""The cross-venue job: snapshots → top of book → states → episodes.

Each stage reads its input more than once, so every stage is written for the next.
The tables below ``path`` are replaced when all stages have passed their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation

from sparkodds.operators import books, episodes, quality, states
from sparkodds.operators.slices import DEFAULT_SLICE_SECONDS
from sparkodds.session import materialize
from sparkodds.sources import sinks

# Fixed value: first day of the data that carries source times.
DATA_START = "2026-07-25"


@dataclass
class Arbitrage:
    quotes: DataFrame
    bbo: DataFrame
    states: DataFrame
    episodes: DataFrame
    counts: dict[str, object] = field(default_factory=dict)


def build(
    snapshots: DataFrame,
    matched: DataFrame,
    metadata: DataFrame,
    since: str | None = DATA_START,
    slice_seconds: float = DEFAULT_SLICE_SECONDS,
    blackout_seconds: float = episodes.BLACKOUT_SECONDS,
    key: str = "game_key",
    path: str | None = None,
    through: str = "episodes",
) -> Arbitrage:
    """All stages up to ``through`` (quotes, bbo, states or episodes); with
    ``path`` and all stages also as parquet tables arb_* below it. ``counts`` says
    how many snapshots there were, how many lacked a source time, and how many
    written rows failed a check; all are counted in the passes that write. The
    first two are seen before the join, so a lost executor may add to them."""
    out, source = Arbitrage(None, None, None, None), Observation()
    out.quotes = materialize(books.quotes(snapshots, matched, key, source))
    out.counts.update(source.get)
    if through == "quotes":
        return out
    changes = books.bbo_changes(out.quotes, since, slice_seconds)
    if through == "bbo":
        out.bbo = changes
        return out
    out.bbo = materialize(changes)
    assembled = states.states(out.bbo, slice_seconds)
    if through == "states":
        out.states = assembled
        return out
    out.states, found = quality.written(assembled, quality.bad_states())
    out.counts.update({n: found[n] for n in quality.bad_states()})
    out.episodes = episodes.episodes(out.states, metadata, slice_seconds, blackout_seconds)
    if path:
        out.episodes, found = quality.written(out.episodes, quality.bad_episodes())
        out.counts.update({n: found[n] for n in quality.bad_episodes()})
        quality.gate_counts(out.counts, {**quality.bad_states(), **quality.bad_episodes()})
        info = episodes.build_info(out.bbo, out.states, out.episodes)
        for name in ("quotes", "bbo", "states", "episodes"):
            setattr(out, name, sinks.rebuild(getattr(out, name), f"{path}/arb_{name}"))
        sinks.rebuild(sinks.with_built_at(info), f"{path}/arb_build_info")
    return out
