"""Evidence floors and caps. The published behaviour depends on them."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    text_cap: int = 8000
    said_head: int = 800
    paste_bound: int = 2000
    reply_cap: int = 800
    excerpt: int = 300
    terms_cap: int = 24
    vocabulary: int = 220
    rare_min: int = 3
    rare_ceiling_min: int = 20
    rare_fraction: float = 0.025
    lift_cut: float = 2.0
    min_sessions: int = 3
    trend_min: int = 6
    rise: float = 1.3
    fade: float = 0.7
    burst_share: float = 0.5
    adjacency_min: int = 30
    action_min: int = 30
    adjacency_p: float = 0.1
    adjacency_lift: float = 5.0
    slip_min: int = 15
    slip_sessions: int = 8
    stumble_sessions: int = 5
    reach_min: int = 30
    recent_days: int = 21
    explanation_min: int = 800
    ritual_pairs: int = 10
    ritual_sessions: int = 3
    ritual_p: float = 0.5
    ritual_headroom: float = 0.5
    delivery_min: int = 10
    delivery_sessions: int = 3
    delivery_share: float = 0.7
    delivery_top: int = 3
    signature_count: int = 3
    signature_sessions: int = 3
    signature_lift: float = 5.0
    chain_count: int = 4
    chain_sessions: int = 3
    rule_count: int = 3
    rule_sessions: int = 3
    lesson_window: int = 6
    arrival_count: int = 15
    arrival_sessions: int = 5
    arrival_days: int = 30
    anchor_share: float = 0.7
    island_gap_days: int = 30
    budget_chars: int = 5800
    history: int = 12


DEFAULT = Thresholds()
