"""Conversation structure repair: cheapest edits by dynamic programming, least audit by path ranking.

The rows of all conversations are put in one order, each with a place ``at``; only ids, digests of role
and text and flags travel there, never texts. A conversation's rows within 4,096 consecutive places are
a segment of one byte a row. A segment is reduced to a matrix of least costs between the four states of
``(s?(ua)+)?`` (nothing yet, after s, after u, after a); folding these matrices from a conversation's last
segment gives the cost to go at every segment's end, so a conversation of any length is solved in pieces.

Within a segment the nodes (row, state) are joined by the arcs that lie on a cheapest way: edits D, I, K
and R. Nodes are ranked by the audit of their next 1, 2, 4, ... edits: the rank at twice the length comes
from a node's own rank and the rank of the node its pointer leads to, and the pointer is doubled. A node's
least path takes the arc of the least initial and, by rank, least audit after it; the path from a state at
the segment's start is read off doubled pointers. Joining exit states from the first segment on selects the
pieces of a conversation's audit.

A conversation's audit is one value and its hash runs over its repaired text in order, so these two end
in one task per conversation; the text streams through it in order and is never held as a whole.

Defined results: null conv_id, turn, role and text read as one space, a null conv_id being its own
conversation. Rows of one turn stand by digest of role and text. A role without initial is never kept.
Repeated rows are duplicates like any other. An empty table gives no rows. Other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.llm.store import stored

#: Places of a segment, as a power of two.
SEGMENT_BITS = 12
#: Costs of the edits, and what a truncated row adds unless it is deleted.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
FAR = 1 << 40
# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Fixed by (s?(ua)+)?.
AFTER = np.array([2, 2, 3, 2])
#: KEPT[initial of s, u, a, other][state]: the state after keeping such a row, or -1.
KEPT = np.array([[1, -1, -1, -1], [2, 2, -1, 2], [-1, -1, 3, -1], [-1, -1, -1, -1]])
ENDS = np.array([0, FAR, FAR, 0])
#: Least cost of inserting the way from one state to another.
FILL = np.array([[0, FAR, 3, 6], [FAR, 0, 3, 6], [FAR, FAR, 0, 3], [FAR, FAR, 3, 0]])
_SPACE = " \t\n\x0b\x0c\r"


def damage(conversations: DataFrame) -> DataFrame:
    """(key, turn, role, text) after the contract's damage by crc32 of ``conv_id:turn``."""
    key, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    rows = conversations.select(
        key.alias("key"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(F.concat(key, F.lit(":"), turn)) % 20).alias("kind"),
    )
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where(kind != 0).select(
        "key", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def digest() -> Column:
    """Of role and text together; the role's length keeps the two apart."""
    return F.unhex(F.sha2(F.concat_ws(":", F.char_length("role"), "role", "text"), 256))


def in_order(rows: DataFrame) -> DataFrame:
    """Slim rows with their place ``at``, written sorted; equal rows may lie in several tasks."""
    trimmed = F.rtrim(F.col("text"), F.lit(_SPACE))
    initial = F.array_position(F.array(*[F.lit(c) for c in "sua"]), F.substring("role", 1, 1)).cast("int")
    slim = rows.select(
        "key", "turn", digest().alias("digest"), F.when(initial > 0, initial - 1).otherwise(3).alias("initial"),
        (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
        F.monotonically_increasing_id().alias("scanned"),
    )
    order = ("key", "turn", "digest", "scanned")
    placed = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(placed.withColumn("at", F.monotonically_increasing_id()).drop("scanned"), "turns")


def segments(turns: DataFrame) -> DataFrame:
    """(key, block, start, codes, counts) of each conversation's rows within a block of places.

    A code is initial + 4 for blank, 8 for duplicate or 12 for truncated rows.
    """
    first = turns.groupBy("key", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), 1).when(F.col("first").isNull(), 2).when(F.col("cut"), 3).otherwise(0)
    coded = turns.join(first, "at", "left").select(
        "key", F.shiftright("at", SEGMENT_BITS).alias("block"), "at", fault.alias("fault"), (F.col("initial") + 4 * fault).alias("code")
    )
    held = coded.groupBy("key", "block").agg(
        F.sort_array(F.collect_list(F.struct("at", "code"))).alias("rows"),
        *[F.count_if(F.col("fault") == k).alias(name) for k, name in ((1, "blank"), (2, "duplicate"), (3, "truncated"))],
    )
    codes = F.col("rows.code")
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes)), lambda a, b: a % 4 * 4 + b % 4)
    illegal = F.size(F.filter(pairs, lambda p: ~p.isin(1, 6, 9)))
    return held.select(
        "key", "block", F.col("rows")[0]["at"].alias("start"), codes.alias("codes"), "blank", "duplicate", "truncated",
        F.when(F.size(codes) > 1, illegal).otherwise(0).alias("illegal"),
        (codes[0] % 4).alias("head"), (F.element_at(codes, -1) % 4).alias("tail"),
    )


def steps() -> np.ndarray:
    """Least cost over one row, for each code, between states (with inserts before it)."""
    out = np.full((16, 4, 4), FAR)
    for code in range(16):
        fault, initial = divmod(code, 4)
        row = np.full((4, 4), FAR)
        extra = TRUNCATED if fault == 3 else 0
        for q in range(4):
            row[q, q] = DELETE
            if fault in (0, 3):
                row[q, AFTER[q]] = min(row[q, AFTER[q]], REROLE + extra)
                if KEPT[initial][q] >= 0:
                    row[q, KEPT[initial][q]] = min(row[q, KEPT[initial][q]], extra)
        out[code] = np.minimum((FILL[:, :, None] + row[None]).min(axis=1), FAR)
    return out


STEPS = steps()


def costs_to_go(codes: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(rows + 1) x 4: the least cost from each node, given those at the end."""
    out = np.empty((len(codes) + 1, 4), np.int64)
    out[-1] = end
    for i in range(len(codes) - 1, -1, -1):
        out[i] = np.minimum((STEPS[codes[i]] + out[i + 1]).min(axis=1), FAR)
    return out


def crossing(codes: np.ndarray) -> np.ndarray:
    """Least costs from the states at a segment's start to those at its end."""
    out = np.where(np.eye(4, dtype=bool), 0, FAR)
    for code in codes[::-1]:
        out = np.minimum((STEPS[code][:, :, None] + out[None]).min(axis=1), FAR)
    return out


def least_paths(codes: np.ndarray, end: np.ndarray, last: bool) -> tuple[np.ndarray, list[str], list[int]]:
    """Costs to go at the start, and for each state there the least cheapest audit and where it ends.

    ``last``: the segment ends its conversation, so inserts may follow its last row.
    """
    n = len(codes)
    go = costs_to_go(codes, end)
    fault, initial = codes // 4, codes % 4
    nodes = (n + 1) * 4
    row, state = np.divmod(np.arange(nodes), 4)
    inner = row < n
    safe = np.minimum(row, n - 1) if n else row
    f, k = (fault[safe], KEPT[initial[safe], state]) if n else (row, row)
    usable = inner & ((f == 0) | (f == 3))
    extra = np.where(f == 3, TRUNCATED, 0)
    below = np.minimum(row + 1, n) * 4
    # Arcs in the order of their initials: D, I, K, R.
    target = np.stack([below + state, row * 4 + AFTER[state], below + np.maximum(k, 0), below + AFTER[state]])
    cost = np.stack([np.full(nodes, DELETE), np.full(nodes, INSERT), extra, REROLE + extra])
    open_ = np.stack([inner, inner | last, usable & (k >= 0), usable])
    flat = go.ravel()
    best = open_ & (cost + flat[target] == flat) & (flat < FAR)
    here = np.arange(nodes)
    initials = np.where(best, np.arange(1, 5)[:, None], 9).min(axis=0) % 9
    pointer = np.where(initials > 0, target[np.maximum(initials, 1) - 1, here], here)
    # Rank by the next 1, 2, 4, ... initials; a node that goes nowhere ranks before all others.
    rank = initials
    while (pointer[pointer] != pointer).any():
        _, rank = np.unique(rank * (nodes + 1) + rank[pointer], return_inverse=True)
        pointer = pointer[pointer]
    # The arc of the least audit: its initial, then the rank of what follows.
    follow = np.where(best, np.arange(1, 5)[:, None] * (nodes + 1) + rank[target], FAR)
    arc = np.where(best.any(axis=0), follow.argmin(axis=0), -1)
    doubled = [np.where(arc >= 0, target[np.maximum(arc, 0), here], here)]
    while (doubled[-1][doubled[-1]] != doubled[-1]).any():
        doubled.append(doubled[-1][doubled[-1]])
    audits, exits = [], []
    for start in range(4):
        path = _along(start, doubled)
        audits.append("".join("DIKR"[a] for a in arc[path] if a >= 0))
        exits.append(int(state[path[-1]]) if len(path) else start)
    return go[0], audits, exits


def _along(start: int, doubled: list[np.ndarray]) -> np.ndarray:
    """Nodes of the path from a start: a level's pointers lead as many edits on as nodes are known."""
    path = np.array([start])
    for jump in doubled:
        path = np.concatenate([path, jump[path]])
    keep = np.ones(len(path), bool)
    keep[1:] = path[1:] != path[:-1]
    return path[keep]


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [crossing(np.asarray(c, np.int64)).ravel().tolist() for c in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["key", "block", "m"])


def _folding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key, and by falling block: the cost to go at each segment's end."""
    final = np.minimum((FILL + ENDS).min(axis=1), FAR)
    key, go = None, final
    for batch in batches:
        ends, lasts = [], []
        for k, m in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            lasts.append(k != key)
            if k != key:
                key, go = k, final
            ends.append(go.tolist())
            go = np.minimum((np.array(m, np.int64).reshape(4, 4) + go).min(axis=1), FAR)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(ends, pa.list_(pa.int64())), pa.array(lasts, pa.bool_())], ["key", "block", "ends", "last"]
        )


def _ranking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [
            least_paths(np.asarray(c, np.int64), np.asarray(e, np.int64), last)
            for c, e, last in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist())
        ]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array([int(g[0]) for g, _, _ in found], pa.int64()),
                pa.array([a for _, a, _ in found], pa.list_(pa.string())), pa.array([x for _, _, x in found], pa.list_(pa.int32())),
            ],
            ["key", "block", "cost", "audits", "exits"],
        )


def _entering(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by key, and by rising block: the state each segment is entered in, and whether it is the first."""
    key, state, tail = None, 0, None
    for batch in batches:
        entries, firsts, seams = [], [], []
        for k, exits, head, end in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3, 4)]):
            firsts.append(k != key)
            seams.append(int(k == key and 4 * tail + head not in (1, 6, 9)))
            if k != key:
                key, state = k, 0
            entries.append(state)
            state, tail = exits[state], end
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(entries, pa.int32()), pa.array(firsts, pa.bool_()), pa.array(seams, pa.int64())],
            ["key", "block", "entry", "first", "seam"],
        )


def _editing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per line of the repaired conversation: where its text lies, and its new role if it has one."""
    for batch in batches:
        keys, blocks, places, ats, roles = [], [], [], [], []
        for key, block, start, codes, piece, state in zip(*[c.to_pylist() for c in batch.columns]):
            row = 0
            for place, edit in enumerate(piece):
                if edit != "D":
                    after = int(KEPT[codes[row] % 4][state]) if edit == "K" else int(AFTER[state])
                    keys.append(key)
                    blocks.append(block)
                    places.append(place)
                    ats.append(None if edit == "I" else start + row)
                    roles.append(None if edit == "K" else "user" if after == 2 else "assistant")
                    state = after
                row += edit != "I"
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array(blocks, pa.int64()), pa.array(places, pa.int32()), pa.array(ats, pa.int64()), pa.array(roles, pa.string())],
            ["key", "block", "place", "at", "role"],
        )


def _hashing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of each conversation's lines; a hash takes them in as they pass."""
    key, running = None, None
    for batch in batches:
        done = []
        for k, line in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = line.as_py().encode()
            if k == key:
                running.update(b"\n" + data)
            else:
                if key is not None:
                    done.append((key, running.hexdigest()))
                key, running = k, hashlib.sha256(data)
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], ["key", "sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([running.hexdigest()], pa.string())], ["key", "sha"])


def solve(parts: DataFrame) -> DataFrame:
    """(key, block, start, codes, entry, first, seam, cost, piece): every segment's part of the least audit."""
    crossed = parts.select("key", "block", "codes").mapInArrow(_crossing, "key string, block bigint, m array<bigint>")
    ends = crossed.repartition("key").sortWithinPartitions("key", F.desc("block")).mapInArrow(
        _folding, "key string, block bigint, ends array<bigint>, last boolean"
    )
    ranked = stored(
        parts.select("key", "block", "codes").join(ends, ["key", "block"]).select("key", "block", "codes", "ends", "last")
        .mapInArrow(_ranking, "key string, block bigint, cost bigint, audits array<string>, exits array<int>"),
        "audits",
    )
    entered = (
        ranked.select("key", "block", "exits").join(parts.select("key", "block", "head", "tail"), ["key", "block"])
        .repartition("key").sortWithinPartitions("key", "block")
        .mapInArrow(_entering, "key string, block bigint, entry int, first boolean, seam bigint")
    )
    return (
        parts.join(ranked.drop("exits"), ["key", "block"]).join(entered, ["key", "block"])
        .withColumn("piece", F.col("audits")[F.col("entry")]).drop("audits")
    )


def repaired_lines(rows: DataFrame, turns: DataFrame, solved: DataFrame) -> DataFrame:
    """(key, block, place, role, text) of every line of the repaired conversations, in order of block and place."""
    edits = stored(
        solved.select("key", "block", "start", "codes", "piece", "entry")
        .mapInArrow(_editing, "key string, block bigint, place int, at bigint, role string"),
        "edits",
    )
    # A row that stays is the only one of its role and text in its conversation.
    texts = rows.select("key", digest().alias("digest"), F.col("role").alias("own"), "text").groupBy("key", "digest").agg(
        F.first("own").alias("own"), F.first("text").alias("text")
    )
    staying = (
        edits.where("at is not null").join(turns.select("at", "digest"), "at").join(texts, ["key", "digest"])
        .select("key", "block", "place", F.coalesce("role", "own").alias("role"), "text")
    )
    return staying.unionByName(edits.where("at is null").select("key", "block", "place", "role", F.lit("").alias("text")))


def repair(conversations: DataFrame) -> DataFrame:
    """One row per original conv_id: faults, least cost, audit and hash of the repaired conversation."""
    rows = damage(conversations)
    turns = in_order(rows)
    parts = stored(segments(turns), "segments")
    solved = stored(solve(parts), "solved")
    lines = repaired_lines(rows, turns, solved)
    hashes = (
        lines.select("key", F.concat("role", F.lit(":"), "text").alias("line"), "block", "place")
        .repartition("key").sortWithinPartitions("key", "block", "place").select("key", "line").mapInArrow(_hashing, "key string, sha string")
    )
    totals = solved.groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        F.sum(F.col("illegal") + F.col("seam")).alias("illegal"), F.sum(F.when(F.col("first"), F.col("cost"))).alias("cost"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "piece"))), lambda p: p["piece"]), "").alias("audit"),
    )
    turn = turns.groupBy("key", "turn").count().groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return (
        conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
        .withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
        .join(turn, "key", "left").join(totals, "key", "left").join(hashes, "key", "left")
        .select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(empty)).alias("repaired_sha256"))
    )
