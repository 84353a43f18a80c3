"""Groups of replicas that converge: a message protocol, and the same as whole-table rounds.

Replica exchanges four kinds of messages. Gossip carries a sender's root, with the pairs it put or none to ask for a full
sync; get asks for pages by hash, put answers with them, missing says that some aren't there any more. A replica asks for
the pages that it lacks and for those below them but what it has, until a peer's tree is whole, checks each page's hash,
and then merges. How messages travel is up to a transport. anti_entropy() does the same for tables of replicas: in every round each one merges
another's entries, in log2 of their number rounds all have everything.
"""

from __future__ import annotations

import contextlib
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.encoding import ABSENT, digest, prefixed
from ..functions.mergers import merge_values
from ..sources.stores import SnapshotStore, Store
from ..sources.tables import written
from .pages import tree_roots
from .reach import as_hashes, reachable, reached
from .spec import TreeError, TreeSpec, text
from .tree import MerkleTree


@dataclass
class Message:
    """kind is gossip, get, put or missing; pairs, hashes, held and pages are frames, pairs None asks for a full sync.

    A get with held, the hashes of pages that its sender has, asks for all other pages below its hashes too.
    """

    kind: str
    sender: str
    root: str | None = None
    pairs: DataFrame | None = None
    hashes: DataFrame | None = None
    held: DataFrame | None = None
    pages: DataFrame | None = None


class Transport(Protocol):
    def send(self, to: str, message: Message) -> None: ...

    def broadcast(self, message: Message) -> None: ...


def page_digests(built: DataFrame, algorithm: str) -> DataFrame:
    """Pages with the hash that their contents have, as column actual."""
    kind = built.schema["entries"].dataType.elementType
    text_in = lambda e, name: prefixed(text(e[name], kind[name].dataType))
    body = F.array_join(F.transform("entries", lambda e: F.concat(text_in(e, "key"), text_in(e, "value"), prefixed(e["next"]))), "")
    return built.withColumn("actual", digest(F.concat(F.col("level").cast("string"), F.lit("|"), F.coalesce("low", F.lit(ABSENT)), F.lit("|"), body), algorithm))


class Replica:
    """One member of a group: a tree, and the merges that wait for pages."""

    def __init__(self, spark: SparkSession, node_id: str, transport: Transport, spec: TreeSpec = TreeSpec(), store: Store | None = None, max_merges: int = 6, max_same_merge: int = 1, on_merge: Callable[[str, str], None] | None = None):
        if not all(callable(getattr(transport, name, None)) for name in ("send", "broadcast")):
            raise TreeError("a transport needs send and broadcast", transport=type(transport).__name__)
        self.node_id, self.transport, self.on_merge = node_id, transport, on_merge
        self.tree = MerkleTree(spark, spec, store or SnapshotStore(spark))
        self.max_merges, self.max_same_merge = max_merges, max_same_merge
        self.waiting: dict[str, str] = {}
        # Roots merged so far, and the own root after the last change that this replica made or took over.
        self.merged: set[str] = set()
        self.grown: str | None = None

    def root(self) -> str | None:
        return self.tree.root()

    def put(self, source: DataFrame, broadcast: bool = True) -> bool:
        """Puts rows, and gossips them if that changed the root."""
        known, old = self._known(), self.root()
        changed = self.tree.put(source)
        self.merged, self.grown = known | {old}, self.root()
        if changed and broadcast:
            self.transport.broadcast(Message("gossip", self.node_id, self.root(), pairs=self.tree.spec.rows(source)))
        return changed

    def merges(self) -> list[str]:
        """Peers whose pages this one waits for."""
        return list(self.waiting)

    def cancel_merge(self, peer: str) -> None:
        self.waiting.pop(peer, None)

    def trigger(self, peer: str) -> None:
        """Asks a peer to take over this tree; nothing for itself."""
        if peer != self.node_id:
            self.transport.send(peer, Message("gossip", self.node_id, self.root()))

    def gc(self, epoch: int | None = None) -> dict[str, int]:
        """Keeps the own root and those of waiting merges."""
        return self.tree.gc(epoch=epoch) if epoch is not None else self.tree.gc(keep=[r for r in (self.root(), *self.waiting.values()) if r])

    def handle(self, message: Message) -> None:
        found = {"gossip": self._gossip, "get": self._get, "put": self._put, "missing": self._missing}.get(message.kind)
        if found is None:
            raise TreeError("unknown message", kind=message.kind)
        found(message)

    def _gossip(self, message: Message) -> None:
        if message.root == self.root():
            return
        if message.pairs is not None:
            whole = self.tree.entries()
            rows = message.pairs if whole is None else whole.unionByName(message.pairs)
            known, old = self._known(), self.root()
            self.tree._commit(merge_values(rows, self.tree.spec.merger, "key"))
            self.merged, self.grown = known | {old}, self.root()
            if self.root() != old:
                self._settle()
                self.transport.broadcast(Message("gossip", self.node_id, self.root(), pairs=message.pairs))
                if self.root() == message.root:
                    return
        self._maybe_merge(message.sender, message.root)

    def _settle(self) -> None:
        """Forgets waiting merges of what is the own root now."""
        self.waiting = {peer: root for peer, root in self.waiting.items() if root != self.root()}

    def _maybe_merge(self, peer: str, root: str | None) -> None:
        if root is None:
            self.trigger(peer)  # it has nothing to give, but may take
            return
        # Asking again for what is on its way, with each gossip that comes meanwhile, would multiply messages.
        if self.waiting.get(peer) == root or root in self._known():
            return
        others = {p: r for p, r in self.waiting.items() if p != peer}
        if len(others) < self.max_merges and sum(r == root for r in others.values()) < self.max_same_merge:
            self.waiting[peer] = root
            self._advance(peer)

    def _known(self) -> set[str]:
        """Roots whose contents the tree has taken over; a tree only grows, so that merging them again changes nothing."""
        if self.root() != self.grown:
            self.merged, self.grown = set(), self.root()
        return self.merged

    def _advance(self, peer: str) -> None:
        """Asks for what is lacking of a peer's tree, or merges it if nothing is."""
        root, there = self.waiting[peer], self.tree.store.list()
        if there is None or there.where(F.col("hash") == root).isEmpty():
            lacking = as_hashes(self.tree.spark, root)
        else:
            found = written(reached(there, root), "reached")
            lacking = written(found.join(there.select("hash").hint("merge"), "hash", "left_anti"), "lacking")
            if lacking.isEmpty():
                self._merge(peer, root, there.join(found.hint("merge"), "hash", "left_semi"))
                return
        held = there.select("hash") if there is not None else lacking.limit(0)
        self.transport.send(peer, Message("get", self.node_id, self.root(), hashes=lacking, held=held))

    def _merge(self, peer: str, root: str, theirs: DataFrame) -> None:
        known, changed = self._known(), True
        if self.root() is None:
            self.tree.adopt(root, theirs)
        else:
            changed = self.tree.merge(self.tree, root, theirs)
        self.merged, self.grown = {*known, root}, self.root()
        self.cancel_merge(peer)
        self._settle()
        if self.on_merge:
            with contextlib.suppress(Exception):  # a listener's fault isn't the replica's
                self.on_merge(self.node_id, peer)
        if changed and self.root() != root:
            self.trigger(peer)

    def _get(self, message: Message) -> None:
        there, present = self.tree.store.list(), None
        if there is not None:
            if message.held is None:
                found = there.join(message.hashes.hint("merge"), "hash", "left_semi")
            else:
                found = reachable(there, message.hashes, unique=True).join(message.held.hint("merge"), "hash", "left_anti")
            present = written(found, "sent")
        if present is None or present.join(message.hashes, "hash", "left_semi").count() < message.hashes.distinct().count():
            self.transport.send(message.sender, Message("missing", self.node_id))
        else:
            self.transport.send(message.sender, Message("put", self.node_id, pages=present))
        if message.root != self.root():
            self._maybe_merge(message.sender, message.root)

    def _put(self, message: Message) -> None:
        if message.sender not in self.waiting:
            return
        wrong = page_digests(message.pages, self.tree.spec.algorithm).where("actual <> hash").select("hash", "actual").first()
        if wrong:
            raise TreeError("a page isn't what its hash says", **wrong.asDict())
        self.tree.put_pages(message.pages)
        self._advance(message.sender)

    def _missing(self, message: Message) -> None:
        self.cancel_merge(message.sender)


@dataclass
class LocalNetwork:
    """A transport that delivers messages in order, one at a time, between replicas of this process."""

    members: dict[str, Replica] = field(default_factory=dict)
    queue: deque = field(default_factory=deque)
    delivered: int = 0

    def port(self, node_id: str) -> _Port:
        return _Port(self, node_id)

    def join(self, replica: Replica) -> None:
        self.members[replica.node_id] = replica

    def run(self, most: int = 1000) -> int:
        """Delivers until nothing is under way; the number of messages."""
        n = 0
        while self.queue:
            if n >= most:
                raise TreeError("messages don't end", delivered=n)
            to, message = self.queue.popleft()
            if to in self.members:
                self.members[to].handle(message)
            n += 1
        self.delivered += n
        return n


@dataclass
class _Port:
    network: LocalNetwork
    node_id: str

    def send(self, to: str, message: Message) -> None:
        self.network.queue.append((to, message))

    def broadcast(self, message: Message) -> None:
        for other in self.network.members:
            if other != self.node_id:
                self.network.queue.append((other, message))


def replica_roots(replicas: DataFrame, spec: TreeSpec = TreeSpec()) -> DataFrame:
    """replica and root of (replica, key, value), all trees built in one go."""
    return tree_roots(replicas.withColumnRenamed("replica", "tree"), spec).withColumnRenamed("tree", "replica")


def converged(replicas: DataFrame, spec: TreeSpec = TreeSpec()) -> DataFrame:
    """(replica, key, value) once every replica has merged all others: one aggregate over keys, then a row per replica."""
    names = replicas.agg(F.collect_set("replica").alias("names"))  # one row, as long as there are replicas
    whole = merge_values(replicas, spec.merger, "key")
    return whole.join(F.broadcast(names)).select(F.explode("names").alias("replica"), "key", "value")


def anti_entropy(replicas: DataFrame, spec: TreeSpec = TreeSpec()) -> tuple[DataFrame, DataFrame]:
    """Entries after convergence, and (round, replica, n_entries, root) of every round from 0, the start.

    In round i each replica merges the entries of the one 2 ** (i - 1) places on. Replicas are few and named on the
    driver; entries stay in tables, and a round is one aggregate by replica and key.
    """
    spark = replicas.sparkSession
    names = sorted(r[0] for r in replicas.select("replica").distinct().collect())
    place = spark.createDataFrame([(n, i) for i, n in enumerate(names)], f"replica {replicas.schema['replica'].dataType.simpleString()}, place int")
    now = written(merge_values(replicas, spec.merger, "replica", "key"), "round")
    history, step, i = [], 1, 0
    while True:
        found = written(now.groupBy("replica").agg(F.count("*").alias("n_entries")).join(replica_roots(now, spec), "replica").select(F.lit(i).alias("round"), "replica", "n_entries", "root"), "roots")
        history.append(found)
        if found.select("root").distinct().count() <= 1:
            return now, reduce(DataFrame.unionByName, history)
        count = max(1, len(names))
        # Rows of a replica also go to the one that merges it in this round.
        numbered = now.join(F.broadcast(place), "replica")  # a row per replica
        receivers = place.select(F.col("place").alias("to"), F.col("replica").alias("taker"))
        sent = numbered.withColumn("to", F.pmod(F.col("place") - F.lit(step), F.lit(count))).join(F.broadcast(receivers), "to").select(F.col("taker").alias("replica"), "key", "value")
        now = written(merge_values(now.select("replica", "key", "value").unionByName(sent), spec.merger, "replica", "key"), "round")
        i, step = i + 1, step * 2 if step * 2 < count else 1
