"""Epoch plan: hard and normal batches in shuffled order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringmatch.operators import assignment, batches
from ringmatch.operators.audits import require_empty
from ringmatch.operators.lookups import plan_lookup
from ringmatch.operators.mining import pool_mismatch
from ringmatch.plans.evaluate import open_pool
from ringmatch.session import durable


@dataclass(frozen=True)
class PlanSettings:
    """Batch geometry and stage configuration of a run."""

    stages: Sequence[dict]
    refresh: Sequence[int]
    fovs: Sequence[int] = (360, 180, 90, 70)
    per_fov: int = 16
    rank_range: tuple[int, int] = (1, 64)
    dataset: str = "pano"
    seed: int = 42
    stage_steps: dict[str, int] = field(default_factory=dict)

    @property
    def batch_rows(self) -> int:
        return self.per_fov * len(self.fovs)


def hard_rows(
    locations: DataFrame, pool: DataFrame, hard_batches: int, settings: PlanSettings, seed_items: Sequence[object], rows: int
) -> DataFrame:
    """Anchors with their assigned neighbours."""
    fovs = list(settings.fovs)
    need = settings.per_fov - 1
    fov_order = F.create_map(*[F.lit(x) for i, f in enumerate(fovs) for x in (int(f), i)])
    anchors = batches.hard_anchors(locations, hard_batches, fovs, seed_items, rows)
    priority = F.element_at(fov_order, F.col("fov_deg").cast("int")).cast("bigint") * hard_batches + F.col("batch")
    anchors = durable(anchors.withColumn("priority", priority))
    low, high = settings.rank_range
    preferences = assignment.shuffled_preferences(
        anchors.select("priority", "fov_deg", "location"), pool, settings.rank_range, seed_items
    )
    chosen = assignment.assign_neighbours(
        anchors.select("priority", "fov_deg", "location"), preferences, locations, need, high - low + 1, seed_items, rows
    )
    columns = ["kind", "batch", "fov_deg", "offset", "location"]
    neighbours = chosen.join(anchors.select("priority", "kind", "batch", "fov_deg"), "priority")
    return durable(anchors.select(columns).unionByName(neighbours.select(columns)))


def plan_epoch(
    locations: DataFrame,
    epoch: int,
    settings: PlanSettings,
    pool: DataFrame | None = None,
    rows: int | None = None,
    pool_root: str | None = None,
    pool_metadata: Mapping[str, object] | None = None,
) -> DataFrame:
    """Plan of one epoch: ``epoch, step, position, kind, batch, fov_deg, location, source_epoch, orientation_mode``.

    ``locations`` holds the distinct ``location`` ids of one dataset's manifest; ``pool`` is needed
    only when the epoch's stage asks for hard batches. Instead of ``pool``, ``pool_root`` names the ledger of the
    mined pools and ``pool_metadata`` what the pool must have been mined with (besides its source epoch). A pool of another source epoch than the newest
    earlier refresh, or one that lacks a FoV, is refused, and so is a plan that fails its audit.
    """
    found = plan_lookup(locations.sparkSession, epoch, settings.stages, settings.refresh)
    if found["stage_matches"] != 1:
        raise ValueError(f"Epoch {epoch} belongs to {found['stage_matches']} stages")
    rows = locations.count() if rows is None else rows
    steps = rows // settings.batch_rows
    expected = settings.stage_steps.get(found["stage"], steps)
    if expected != steps:
        raise ValueError(f"Stage {found['stage']} expects {expected} steps, the manifest gives {steps}")
    hard_batches = round(steps * found["hard_batch_fraction"])
    seed_items = (settings.seed, settings.dataset, "train", int(epoch))
    source = found["source_epoch"] if hard_batches else None
    used = None
    if hard_batches:
        if source is None:
            raise ValueError(f"No pool is older than epoch {epoch}")
        if pool is None and pool_root is not None:
            expected = {**(pool_metadata or {}), "source_epoch": source}
            pool = open_pool(locations.sparkSession, pool_root, source, expected)
        if pool is None:
            raise FileNotFoundError("Hard batches need the mined pool of every FoV")
        require_empty(pool_mismatch(pool, source, settings.fovs), f"The pool is not that of epoch {source}")
        used = hard_rows(locations, pool, hard_batches, settings, seed_items, rows)
    normal = batches.normal_fill(
        locations, used, steps - hard_batches, settings.per_fov, settings.fovs, seed_items, rows
    )
    all_rows = normal if used is None else normal.unionByName(used)
    placed = batches.interleave(all_rows, settings.fovs, seed_items)
    schedule = batches.batch_schedule(locations.sparkSession, steps - hard_batches, hard_batches, seed_items)
    plan = placed.join(schedule, ["kind", "batch"]).select(
        F.lit(int(epoch)).cast("bigint").alias("epoch"),
        "step",
        "position",
        "kind",
        "batch",
        "fov_deg",
        "location",
        F.when(F.col("kind") == "hard", F.lit(source)).cast("bigint").alias("source_epoch"),
    )
    plan = durable(batches.sample_requests(plan))
    check_plan(plan, steps, settings)
    return plan


def check_plan(plan: DataFrame, steps: int, settings: PlanSettings, shards: int = 1) -> None:
    """Refuse a plan that reuses a location, has the wrong length or is off its FoV quota."""
    audit = batches.plan_faults(plan, settings.fovs, settings.per_fov, shards).first()
    rows = steps * settings.batch_rows
    if audit["steps"] != steps or audit["rows"] != rows or audit["distinct_locations"] != rows:
        raise RuntimeError(f"Epoch plan reuses a location or has the wrong length: {audit.asDict()}")
    if audit["unbalanced_shards"]:
        raise RuntimeError(f"{audit['unbalanced_shards']} shards are not FoV-balanced")
    if audit["unknown_fovs"]:
        raise RuntimeError(f"{audit['unknown_fovs']} plan rows have unsupported FoVs")
    if audit["position_gaps"]:
        raise RuntimeError(f"{audit['position_gaps']} batches do not have every position once")
