"""Detector, clustering and jump settings.

The numbers in ``DEFAULTS`` are fixed values: they are the defaults a user of
the method expects, stated plainly so results can be compared.
"""

from __future__ import annotations

from copy import deepcopy
from typing import Any

Config = dict[str, Any]

DEFAULTS: Config = {
    "alert_threshold": 0.5,
    "score_cap": 0.95,
    "flipper_filter": {"max_directional_ratio": 0.5, "min_volume_for_pattern": 10_000.0},
    "volume_anomaly": {
        "lookback_window_hours": 24, "min_trades_for_baseline": 10, "z_score_threshold": 3.0,
        "min_absolute_notional": 1000.0, "max_confidence": 0.6},
    "probability_impact": {
        "min_delta_prob": 0.03, "min_delta_log_odds": 0.4, "min_notional": 500.0, "max_confidence": 0.7},
    "accumulation": {
        "min_accumulation_usdc": 5000.0, "min_directional_ratio": 0.8,
        "min_outcome_concentration": 0.9, "max_confidence": 0.8},
    "extreme_position": {"tail_threshold": 0.20, "min_notional": 1000.0, "max_confidence": 0.4},
    "contra_silence": {
        "min_gap_samples": 10, "silence_threshold": 5.0, "min_notional": 1000.0,
        "max_contra_age_minutes": 120.0, "max_confidence": 0.3},
    "orderbook_consumption": {
        "min_levels_consumed": 3, "min_notional": 1000.0, "max_slippage_bps": 50.0, "max_confidence": 0.5},
    "orderbook_imbalance": {"min_imbalance_ratio": 3.0, "min_notional": 800.0, "max_confidence": 0.45},
    "thin_liquidity": {
        "min_depth_ratio": 0.3, "max_total_depth": 5000.0, "min_notional": 500.0, "max_confidence": 0.55},
    "recidivism": {"min_prior_flags": 1, "midpoint": 5.0, "k": 0.7, "max_confidence": 0.8},
    "new_wallet": {"min_notional": 1000.0, "max_age_minutes": 60, "max_confidence": 0.4},
    "cluster_coordination": {
        "base_confidence": 0.2, "size_threshold": 5, "size_bonus": 0.2, "density_threshold": 0.8,
        "density_bonus": 0.2, "ownership_bonus": 0.3, "max_confidence": 0.85},
    "clustering": {
        "min_trade_size": 5000.0, "bucket_size": 300, "size_normalizer": 12_000.0, "max_size_mult": 5.0,
        "max_time_window": 3600, "same_direction_mult": 2.0, "cross_outcome_penalty": 0.1,
        "k_core": 2, "min_edge_weight": 20.0,
        "min_cluster_interval": 300, "max_cluster_interval": 3600, "significant_change_threshold": 20},
    "cluster_boost": {
        "max_boost_factor": 2.0, "size_weight": 0.3, "density_weight": 0.2, "ownership_boost": 0.4,
        "size_normalizer": 50.0},
    "attribution": {
        "min_size_for_attribution": 5, "min_density_for_attribution": 0.4, "ownership_flag_threshold": 1},
    "jumps": {
        "jump_threshold": 0.05, "jump_window_minutes": 30, "pre_jump_lookback_minutes": 60,
        "min_pre_jump_trades": 2, "max_boost_factor": 2.0, "min_trade_notional": 0.0,
        "scoring_interval_minutes": 15, "buffer_hours": 24, "min_buffer_trades": 10,
        "poll_interval_seconds": 5.0},
    "labels": {"metric": "return", "z_score_threshold": 2.0, "min_wallet_notional": 500.0, "min_wallets": 3},
}


def make_config(**overrides: Any) -> Config:
    """Defaults with the given sections (or scalars) replaced or merged."""
    cfg = deepcopy(DEFAULTS)
    for key, value in overrides.items():
        if isinstance(value, dict) and isinstance(cfg.get(key), dict):
            cfg[key].update(value)
        else:
            cfg[key] = value
    return cfg
