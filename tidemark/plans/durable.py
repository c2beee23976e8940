"""A replica over a store: operations are logged before they take effect, and reopening gives them back."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.store import Store
from .sync import Config, LogError, Replica


class DurableReplica(Replica):
    """The node that owns the store. Where the store has a generation, its members count and `peers` is
    left out; else `peers`, changed by the log. Own writes are covered by their node; coverage of others
    is what the last generation kept, so what came since is asked for again."""

    def __init__(self, store: Store, peers: list[int], config: Config | None = None, **more):
        super().__init__(store.spark, store.node, peers, config, **more)
        self.store = store
        state, self.members, self.next_seq = store.load(peers)
        self._set(state)
        self.acks = dict(store.acks)
        if self.next_seq > 1:
            self.adopt({self.node: self.next_seq - 1})
        self.recover_next_seq()

    def _log(self, ops: DataFrame) -> None:
        try:
            self.store.append(ops)
        except Exception as e:  # whatever kept it from the log, it is not there
            raise LogError(f"node {self.node} could not log") from e

    def persist(self, force: bool = False) -> int | None:
        """A new generation of the store, unless nothing changed since the last."""
        with self.lock:  # what the snapshot covers in the log is what its state holds
            return self.store.persist(self.state, self.members, self.next_seq, force, self.acks)

    def close(self) -> None:
        self.store.close()
