"""Equipment ledger analytics on Spark.

Set-at-a-time re-expression of an equipment / stock tracking back end: catalogue, norms, warehouses, stock,
holdings, movements and audit as DataFrames; reports, row scoping, batch movement application with stock
checks, keyed upserts, validated imports and change audit with the public DataFrame / SQL / Structured
Streaming APIs.
"""

from equipledger.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
