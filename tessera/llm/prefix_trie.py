"""Prefix trie of conversations by an LCP-aware external mergesort.

A conversation is the sequence of its turns, and a turn is the first 16 bytes of the SHA-256 of its
role and text. Tasks sort runs of conversations; in a run each row carries how many turns it shares
with the row before (its LCP) and only the turns after them, and conversations that are equal are
one row with all their ids. Splitters from a sample deal the rows of the runs to partitions of the
whole order (turns, then conv_id), where a loser tree merges the runs: heads that share different
numbers of turns with the last output are told apart by those numbers, and only equal ones compare
turns, from there on. The merged stream moves a stack of open nodes along, the path to the current
conversation. A node that the path leaves is finished: it adds its sums to its parent and is emitted
once its parent is finished too, as it carries the parent's smallest member.

What a partition can't finish are the nodes on the path to its first conversation, which may go on in
the partition before, and to its last. Those few are passed on, in order, and the same sweep closes
them over FAN partitions at a time until one is left. Their children that are finished meanwhile get
the parent's id by a join.

Scale: turns are shuffled as digests and sizes, texts never. A sequence that a third of all
conversations share is divided by conv_id, its ids travel packed. A task holds a partition's runs of
about PARTITION_BYTES and one path. The digest of the ids that end at one node is a single SHA-256 by
its definition, so one task streams the packed ids of a node that spans partitions, in order.

Cases: turns are ordered by turn (null first), rows of one turn by the digest of role and text; null
role and text are empty; repeated rows are turns of their own. Rows without conv_id belong to no
conversation. An empty table has no node, not even a root. Further columns don't matter.
"""

from __future__ import annotations

import hashlib
import itertools
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_hot
from .exact_dedup import splitters

#: Bytes of a turn's digest.
TURN = 16
#: Bytes of a sorted run and of a partition of the merge; sampled sequences a partition, and their bytes on the driver; partitions that a later sweep closes together.
RUN_BYTES, PARTITION_BYTES, SAMPLES, SAMPLE_BYTES, FAN = 8 << 20, 24 << 20, 24, 32 << 20, 64
#: What a conversation weighs besides its digests, and a turn besides its digest.
ROW_BYTES, SIZE_BYTES = 64, 8

_NODES = "kind string, part int, pos int, depth int, turn binary, size long, first boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, path binary, parent_path binary, ids binary"
_ARROW = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("pos", pa.int32()), ("depth", pa.int32()), ("turn", pa.binary()), ("size", pa.int64()), ("first", pa.bool_()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()), ("path", pa.binary()), ("parent_path", pa.binary()), ("ids", pa.binary())])
_NONE = hashlib.sha256(b"").hexdigest()
#: Rows of an output batch.
_ROWS = 4096


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: array of (turn, digest in hex, size of the text in UTF-8 bytes), in order. Rows of five neighbouring conversations share a partition, for graft()."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * TURN)
    conv = F.col("conv_id").cast("long")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("size"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select((conv - conv % 5).alias("five"), conv.alias("conv_id"), turn.alias("turn"))
    return rows.repartition("five").groupBy("five", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def graft(convs: DataFrame) -> DataFrame:
    """Of sequences(): the first h turns of conversation conv_id - conv_id % 5 (none, if there is no such one), then the own turns after the first h, h being crc32 of the decimal conv_id modulo 9. No further shuffle."""
    none = F.array().cast(convs.schema["turns"].dataType)
    fives = convs.groupBy("five").agg(F.collect_list(F.struct("conv_id", "turns")).alias("convs"))
    base = F.coalesce(F.get(F.filter("convs", lambda c: c["conv_id"] == F.col("five")), F.lit(0))["turns"], none)
    each = fives.select(base.alias("base"), F.explode("convs").alias("c")).select("base", "c.conv_id", "c.turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    return each.select("conv_id", F.concat(F.slice("base", F.lit(1), h), F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _split(rest: bytes) -> list[bytes]:
    return [rest[i : i + TURN] for i in range(0, len(rest), TURN)]


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share from the first on."""
    low, high = 0, min(len(a), len(b)) // TURN
    if a[: high * TURN] == b[: high * TURN]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: mid * TURN] == b[: mid * TURN] else (low, mid)
    return low


Run = list[tuple[int, bytes, bytes, bytes]]  # LCP, turns after it, their sizes as int64, conv_ids as int64


def sorted_run(rows: list[tuple[bytes, int, bytes]], splits: list) -> Iterator[tuple[int, Run]]:
    """rows: (turns, conv_id, sizes). The sorted run, cut by splits, equal sequences of a piece in one row."""
    rows.sort(key=lambda r: r[:2])
    for part, piece in itertools.groupby(rows, key=lambda r: bisect_right(splits, (r[0], 0, r[1]))):
        run, before = [], b""
        for turns, same in itertools.groupby(piece, key=lambda r: r[0]):
            same = list(same)
            lcp = common(before, turns)
            run.append((lcp, turns[lcp * TURN :], same[0][2][lcp * 8 :], np.array([r[1] for r in same], np.int64).tobytes()))
            before = turns
        yield part, run


class Head:
    """A run's cursor: its sequence, and how many turns that shares with the last output of the merge."""

    __slots__ = ("rows", "path", "sizes", "ids", "least", "lcp", "over")

    def __init__(self, run: Iterable[tuple[int, bytes, bytes, bytes]]):
        self.rows, self.path, self.sizes, self.lcp, self.over = iter(run), [], [], 0, False
        self.advance()

    def advance(self) -> None:
        row = next(self.rows, None)
        if row is None:
            self.over, self.lcp = True, -1
            return
        self.lcp, rest, sizes, ids = row
        self.path[self.lcp :] = _split(rest)
        self.sizes[self.lcp :] = np.frombuffer(sizes, np.int64).tolist()
        self.ids = np.frombuffer(ids, np.int64)
        self.least = int(self.ids[0])


class LoserTree:
    """Merges sorted runs. The winner's LCP is with the last output; a loser's is with whom it lost to, so with each output that comes by its place. compared counts the turns looked at."""

    def __init__(self, runs: Iterable[Run]):
        self.heads = [Head(r) for r in runs]
        self.size = max(1, len(self.heads))
        self.compared = 0
        # Leaves stand behind the inner nodes, which hold losers.
        self.losers: list[Head | None] = [None] * self.size
        at: list[Head | None] = [None] * self.size + [*self.heads]
        for i in range(self.size - 1, 0, -1):
            at[i], self.losers[i] = self.play(at[2 * i], at[2 * i + 1])
        self.winner = at[1] if self.heads else None
        self.place = {id(h): self.size + i for i, h in enumerate(self.heads)}

    def play(self, a: Head, b: Head) -> tuple[Head, Head]:
        """Winner and loser."""
        if a.lcp != b.lcp or a.over:
            return (a, b) if a.lcp >= b.lcp else (b, a)
        n, least = a.lcp, min(len(a.path), len(b.path))
        while n < least and a.path[n] == b.path[n]:
            n += 1
        self.compared += n - a.lcp + 1
        if n < least:
            first = a.path[n] < b.path[n]
        elif len(a.path) != len(b.path):
            first = len(a.path) < len(b.path)
        else:
            first = a.least < b.least
        win, lose = (a, b) if first else (b, a)
        lose.lcp = n
        return win, lose

    def __iter__(self) -> Iterator[Head]:
        """The heads in order of output; each is valid until the next."""
        while self.winner is not None and not self.winner.over:
            yield self.winner
            self.winner.advance()
            at, win = self.place[id(self.winner)] // 2, self.winner
            while at:
                win, self.losers[at] = self.play(win, self.losers[at])
                at //= 2
            self.winner = win


class Node:
    __slots__ = ("turn", "size", "depth", "first", "path", "ids", "least", "n_convs", "n_children", "n_leaves", "saved", "waiting")

    def __init__(self, turn: bytes, size: int, depth: int, first: bool):
        self.turn, self.size, self.depth, self.first = turn, size, depth, first
        self.path: bytes | None = None
        self.ids: list[np.ndarray] = []
        self.least: int | None = None
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.waiting: list[dict] = []

    def add(self, least: int, n_convs: int, n_children: int, n_leaves: int, saved: int) -> None:
        self.least = least if self.least is None else min(self.least, least)
        self.n_convs += n_convs
        self.n_children += n_children
        self.n_leaves += n_leaves
        self.saved += saved


class Sweep:
    """The open path of a sorted stream, and the nodes it leaves.

    part: of the rows emitted. edges: whether nodes on the first and the last path stay open, for a later sweep.
    """

    def __init__(self, part: int, edges: bool):
        self.part, self.edges = part, edges
        self.stack: list[Node] = []
        self.left: list[Node] = []
        self.out: list[dict] = []

    def push(self, turn: bytes, size: int, first: bool = False) -> Node:
        node = Node(turn, size, len(self.stack), first and self.edges)
        self.stack.append(node)
        return node

    def to(self, depth: int) -> None:
        """Leave the open nodes that are deeper."""
        while len(self.stack) > depth + 1:
            self.finish(self.stack.pop())

    def finish(self, node: Node) -> None:
        if node.first:
            self.left.append(node)
            return
        leaves, saved = node.n_leaves or 1, node.saved + (node.n_convs - 1) * node.size
        ends = None
        if node.path is None:
            ids = np.sort(np.concatenate(node.ids)) if node.ids else ()
            ends = hashlib.sha256(",".join(map(str, ids.tolist())).encode()).hexdigest() if len(ids) else _NONE
        row = {"kind": "node", "depth": node.depth, "conv_id": node.least, "n_convs": node.n_convs, "n_children": node.n_children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "path": node.path}
        for child in node.waiting:
            self.out.append(child | {"parent_conv_id": node.least})
        if self.stack:
            self.stack[-1].add(node.least, node.n_convs, 1, leaves, saved)
            self.stack[-1].waiting.append(row)
        else:
            self.out.append(row)

    def sequence(self, head: Head, first: bool) -> None:
        """The next conversations of the merged stream."""
        if not self.stack:
            self.push(b"", 0, first)
        self.to(head.lcp)
        for turn, size in zip(head.path[head.lcp :], head.sizes[head.lcp :]):
            self.push(turn, size, first)
        node = self.stack[-1]
        node.ids.append(head.ids)
        node.add(head.least, len(head.ids), 0, 0, 0)

    def open_node(self, row: dict, first: bool) -> None:
        """The next node that an earlier sweep left open."""
        depth = row["depth"]
        if len(self.stack) > depth and self.stack[depth].turn == row["turn"]:
            node = self.stack[depth]
        else:
            self.to(depth - 1)
            node = self.push(row["turn"], row["size"], first)
            node.path = row["path"]
        if row["conv_id"] is not None:
            node.add(row["conv_id"], row["n_convs"], row["n_children"], row["n_leaves"], row["saved_tokens"])

    def end(self) -> None:
        """Close the stream: all nodes without edges; else the open ones are emitted, in order of depth, the first path before the last."""
        if not self.edges:
            self.to(-1)
            return
        self.left += [n for n in reversed(self.stack) if n.first]
        first, last = self.left[::-1], [n for n in self.stack if not n.first]
        for nodes in (first, [n for n in self.stack if n.first] + last):
            digest = hashlib.sha256()
            for n in nodes:
                digest.update(n.turn)
                n.path = n.path or digest.copy().digest()
        for pos, n in enumerate(first + last):
            self.out.append({"kind": "open", "pos": pos, "depth": n.depth, "turn": n.turn, "size": n.size, "first": n.first, "conv_id": n.least, "n_convs": n.n_convs, "n_children": n.n_children, "n_leaves": n.n_leaves, "saved_tokens": n.saved, "path": n.path})
            if n.ids:
                self.out.append({"kind": "ends", "path": n.path, "ids": np.sort(np.concatenate(n.ids)).tobytes()})
            self.out += [child | {"kind": "child", "parent_path": n.path} for child in n.waiting]

    def batches(self, least: int = _ROWS) -> Iterator[pa.RecordBatch]:
        """What was emitted so far, once it is so many rows."""
        if len(self.out) >= least:
            out, self.out = self.out, []
            for i in range(0, len(out), _ROWS):
                yield pa.RecordBatch.from_pylist([{"part": self.part} | r for r in out[i : i + _ROWS]], _ARROW)


def _runs(convs: DataFrame, partitions: int, splits: list) -> DataFrame:
    """convs: conv_id, turns (binary), sizes (array of long) -> the rows of sorted runs, dealt to the partitions of the whole order."""
    shared = convs.sparkSession.sparkContext.broadcast(splits)
    schema = pa.schema([("part", pa.int32()), ("run", pa.int64()), ("pos", pa.int32()), ("lcp", pa.int32()), ("rest", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, rows = 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held, rows
            for part, run in sorted_run(rows, shared.value):
                for i in range(0, len(run), _ROWS):
                    lcp, rest, sizes, ids = zip(*run[i : i + _ROWS])
                    n = len(lcp)
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(part, pa.int32()), n), pa.repeat(number, n), pa.array(range(i, i + n), pa.int32()), pa.array(lcp, pa.int32()), pa.array(rest, pa.binary()), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], schema=schema)
            number, held, rows = number + 1, 0, []

        for batch in batches:
            for conv, turns, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                rows.append((turns, conv, sizes.values.to_numpy(zero_copy_only=False).astype(np.int64).tobytes()))
                held += len(turns) * (TURN + SIZE_BYTES) // TURN + ROW_BYTES
                if held >= RUN_BYTES:
                    yield from flush()
        yield from flush()

    runs = convs.select("conv_id", "turns", "sizes").mapInArrow(sort, "part int, run long, pos int, lcp int, rest binary, sizes binary, ids binary")
    return runs.repartitionById(partitions, F.col("part")).sortWithinPartitions("run", "pos")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition's runs -> its finished and its open nodes."""
    part, runs, last = TaskContext.get().partitionId(), [], None
    for batch in batches:
        for run, *row in zip(*(batch.column(c).to_pylist() for c in ("run", "lcp", "rest", "sizes", "ids"))):
            if run != last:
                runs.append([])
                last = run
            runs[-1].append(tuple(row))
    sweep = Sweep(part, True)
    for i, head in enumerate(LoserTree(runs)):
        sweep.sequence(head, i == 0)
        yield from sweep.batches()
    sweep.end()
    yield from sweep.batches(1)


def _close(edges: bool):
    """The sweep over open nodes of neighbouring partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, begin = Sweep(TaskContext.get().partitionId(), edges), None
        for batch in batches:
            for row in batch.to_pylist():
                begin = row["part"] if begin is None else begin
                sweep.open_node(row, row["part"] == begin and row["first"])
                yield from sweep.batches()
        sweep.end()
        yield from sweep.batches(1)

    return run


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, ids in order -> the digest of each path's ids. Holds one piece."""
    schema = pa.schema([("path", pa.binary()), ("ends", pa.string())])
    open_path, digest = None, None
    for batch in batches:
        for path, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            new = path != open_path
            if new and digest is not None:
                yield pa.RecordBatch.from_pylist([{"path": open_path, "ends": digest.hexdigest()}], schema)
            if new:
                open_path, digest = path, hashlib.sha256()
            digest.update(("" if new else ",").encode() + ",".join(map(str, np.frombuffer(ids, np.int64).tolist())).encode())
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"path": open_path, "ends": digest.hexdigest()}], schema)


def trie(convs: DataFrame) -> DataFrame:
    """convs: conv_id (long, unique), turns (array of structs with digest and size) -> the nodes: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = convs.sparkSession
    turns = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    rows = checkpointed(convs.select("conv_id", turns.alias("turns"), F.transform("turns", lambda t: t["size"]).alias("sizes")))
    weight = F.octet_length("turns") * (TURN + SIZE_BYTES) / TURN + ROW_BYTES
    n, total = rows.agg(F.count("*"), F.sum(weight)).first()
    partitions = max(1, int((total or 0) // PARTITION_BYTES) + 1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), (n or 0) // 64))
    share = min(1.0, min(SAMPLES * partitions, SAMPLE_BYTES // max(1, (total or 0) // max(1, n))) / max(1, n))
    sample = rows.filter(F.pmod(F.xxhash64("conv_id", F.lit("splitters")), F.lit(1 << 30)) < int(share * (1 << 30))).select("turns", "conv_id").collect() if partitions > 1 else []
    splits = splitters([(bytes(r.turns), 0, r.conv_id) for r in sample], partitions)
    partitions = len(splits) + 1
    level = checkpointed(_runs(rows, partitions, splits).mapInArrow(_merge, _NODES))
    ends = level.filter("kind = 'ends'").select("path", "part", "ids")
    done, late, closed = [], [], []
    while True:
        done.append(level.filter("kind = 'node'"))
        late.append(level.filter("kind = 'child'"))
        if closed and partitions == 1:
            break
        groups = -(-partitions // FAN)
        opened = level.filter("kind = 'open'").withColumn("group", F.floor(F.col("part") / FAN).cast("int"))
        level = checkpointed(opened.repartitionById(groups, F.col("group")).sortWithinPartitions("part", "pos").drop("group").mapInArrow(_close(groups > 1), _NODES))
        closed.append(level.filter("kind in ('node', 'child')").select("path", "conv_id", "depth"))
        partitions = groups
    union = lambda frames: next(iter(frames)) if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    parents = union(closed).select(F.col("path").alias("parent_path"), F.col("conv_id").alias("parent"))
    children = join_hot(union(late), parents, "parent_path").withColumn("parent_conv_id", F.col("parent")).drop("parent")
    nodes = union([*done, children.select(level.columns)])
    shas = ends.repartition("path").sortWithinPartitions("path", "part").select("path", "ids").mapInArrow(_digest_ends, "path binary, ends string")
    # Only nodes that were open have a path: their digests were left to the end.
    was_open = nodes.filter("path is not null").join(shas, "path", "left").withColumn("ends_sha256", F.coalesce("ends", F.lit(_NONE)))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = nodes.filter("path is null").select(names).unionByName(was_open.select(names))
    return out.withColumn("depth", F.col("depth").cast("long"))
