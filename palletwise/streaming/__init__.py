from palletwise.streaming.uploads import (
    inventory_stream,
    landing_manifest,
    running_item_rollup,
    running_pallet_totals,
    start,
)

__all__ = ["inventory_stream", "landing_manifest", "running_item_rollup", "running_pallet_totals", "start"]
