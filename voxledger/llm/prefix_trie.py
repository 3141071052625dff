"""Prefix trie of conversations by Spark SQL ROLLUP over positional turn-id columns.

A turn's id is 16 bytes of the SHA-256 of role and text, then the text's length in UTF-8 bytes. A conversation is cut
into blocks of ``WIDTH`` turns, one row a block with one column a position. One ``ROLLUP`` over these
columns, within the key of the node at which the block begins, aggregates the prefixes of all lengths at
once; ``grouping_id`` tells the length. The key of a node is a 128-bit exclusive or of hashes of (position, turn id), so
the keys at which later blocks begin are running values, and blocks of any number are rolled up together: long
conversations take no rounds.

What a subtree holds is a sum over members. A node belongs to its smallest member; the nodes of one owner are
the tail of its path. So the sum over a subtree is the sum of its members' whole tails, less the part of the
owner's tail above the node, and a second ROLLUP carries it up; nothing walks the tree.

Hot keys: turns are numbered within ranges (``ordering.with_ordinal``), running values go by chunks, groups are
partial aggregates, and joins are equality joins that adaptive execution can split. The members that end at a node are
listed in sorted ranges; only runs that touch the end of a range are hashed on from pieces of at most a megabyte, one
stream a node, since SHA-256 has no other order. No list of members is ever held.

Defined results: a null role or text is empty. Turns of one conversation are in order of turn (null first), equal turn
numbers in order of their ids; repeated rows are repeated turns. Rows without a conversation id belong to none and
are left out. Only conv_id, turn, role and text are read; further columns may have any name. Without conversations there
is no node, not even a root. Texts of any length count as their 21 bytes from the first step on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxledger.llm.tables import stored
from voxledger.operators.ordering import with_ordinal

WIDTH = 8
CHUNK = 4_096
PIECE_BYTES = 1_000_000
TURNS = [f"t{j}" for j in range(WIDTH)]


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of a digest, 5 bytes of length."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.octet_length(text).cast("long")), 10, "0")))


def _bytes(turn: Column) -> Column:
    return F.conv(F.hex(F.substring(turn, 17, 5)), 16, 10).cast("long")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, id): the turns of every conversation from position 0 on."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id(F.col("role"), F.col("text")).alias("id"))
    return stored(with_ordinal(rows.filter("conv_id is not null"), ["turn", "id"], ["conv_id"], "pos").select("conv_id", "pos", "id"), "turns")


def with_shared_heads(turns: DataFrame, group: int = 5, heads: int = 9) -> DataFrame:
    """Numbered turns after giving conversation c the first crc32(c) % ``heads`` turns of c - c % ``group`` for its own.

    Conversations that are left without turns have one row, whose position and id are null.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % heads
    first = turns.filter((F.col("conv_id") % group == 0) & (F.col("pos") < heads - 1))
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("first"))  # at most ``heads`` - 1 turns
    every = turns.select("conv_id").distinct().withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": h})
    taken = F.coalesce(F.slice("first", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<pos:bigint,id:binary>>"))
    plan = stored(every.join(first, "base", "left").select("conv_id", "h", taken.alias("first")), "heads")
    own = turns.join(plan.select("conv_id", "h", F.array_size("first").alias("k")), "conv_id").filter("pos >= h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "id")
    given = plan.select("conv_id", F.explode_outer("first").alias("x")).select("conv_id", "x.pos", "x.id")
    return own.union(given)


def _hashes(pos: Column, turn: Column) -> tuple[Column, Column]:
    return F.xxhash64(pos, turn), F.xxhash64(F.lit(1), pos, turn)


def _running(df: DataFrame, key: str, order: str, how: str, values: dict[str, str]) -> DataFrame:
    """``df`` with exclusive running values (``how``: xor or sum) along ``order`` in each key; values: new name to column.

    A key is scanned in chunks; what is carried into a chunk comes from one row for each chunk before it.
    """
    fold = {"xor": F.bit_xor, "sum": F.sum}[how]
    rows = stored(df.withColumn("_chunk", F.floor(F.col(order) / CHUNK)), "chunks")
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(key, "_chunk").agg(*[fold(c).alias(n) for n, c in values.items()])
    carried = totals.select(key, "_chunk", *[fold(n).over(before).alias(f"_c_{n}") for n in values]).filter("_chunk > 0")
    here = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumns({f"_l_{n}": fold(c).over(here) for n, c in values.items()})
    joined = local.join(carried, [key, "_chunk"], "left")

    def both(n: str) -> Column:
        inside, carry = F.coalesce(f"_l_{n}", F.lit(0)), F.coalesce(f"_c_{n}", F.lit(0))
        return (inside.bitwiseXOR(carry) if how == "xor" else inside + carry).alias(n)

    return joined.select(*df.columns, *map(both, values))


def blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, blk, t0.., n, x, y, px, py): a row a block; its turns, its own key part, and the key before it."""
    hx, hy = _hashes(F.col("pos"), F.col("id"))
    place = F.col("pos") % WIDTH
    rows = turns.withColumns({"blk": F.coalesce(F.floor(F.col("pos") / WIDTH), F.lit(0)), "hx": F.when(F.col("id").isNotNull(), hx), "hy": F.when(F.col("id").isNotNull(), hy)})
    cut = rows.groupBy("conv_id", "blk").agg(
        *[F.max(F.when(place == j, F.col("id"))).alias(t) for j, t in enumerate(TURNS)],
        F.count("id").alias("n"),
        F.coalesce(F.bit_xor("hx"), F.lit(0)).alias("x"),
        F.coalesce(F.bit_xor("hy"), F.lit(0)).alias("y"),
    )
    return _running(cut, "conv_id", "blk", "xor", {"px": "x", "py": "y"})


def _rolled(cut: DataFrame, sums: tuple[str, ...] = ()) -> DataFrame:
    """A row a node: its owner ``rep``, depth, members, key, parent's key, what it saves, and sums over its members."""
    columns = ", ".join(TURNS)
    more = "".join(f", sum({s}) AS {s}" for s in sums)
    rolled = cut.sparkSession.sql(
        f"SELECT blk, px, py, {columns}, {WIDTH} - bit_count(grouping_id()) AS level, count(*) AS n_convs, min(conv_id) AS rep{more} "
        f"FROM {{cut}} GROUP BY blk, px, py, ROLLUP({columns})",
        cut=cut,
    )
    last = F.coalesce(*[F.when(F.col("level") == j + 1, F.col(t)) for j, t in enumerate(TURNS)])
    # Groups past the end of a conversation are none; a later block begins at a node that the block before has.
    nodes = rolled.withColumn("last", last).filter("last is not null or (level = 0 and blk = 0)")
    depth = F.col("blk") * WIDTH + F.col("level")
    key = [F.col("px"), F.col("py")]
    for j, t in enumerate(TURNS):
        there = F.col(t).isNotNull()
        key = [k.bitwiseXOR(F.when(there, h).otherwise(0)) for k, h in zip(key, _hashes(F.col("blk") * WIDTH + j, F.col(t)), strict=True)]
    up = [F.when(F.col("level") > 0, h) for h in _hashes(depth - 1, F.col("last"))]
    saved = F.when(F.col("level") > 0, (F.col("n_convs") - 1) * _bytes(F.col("last"))).otherwise(0)
    flat = nodes.select("rep", depth.cast("long").alias("depth"), "n_convs", key[0].alias("kx"), key[1].alias("ky"), up[0].alias("ux"), up[1].alias("uy"), saved.alias("saved"), "last", *sums)
    return flat.withColumns({"ux": F.col("kx").bitwiseXOR(F.col("ux")), "uy": F.col("ky").bitwiseXOR(F.col("uy"))})


EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted range: the digest of every run of a key inside it, and the texts of its first and last run."""
    schema = pa.schema([("ex", pa.int64()), ("ey", pa.int64()), ("first", pa.int64()), ("digest", pa.string()), ("piece", pa.string())])
    out: list[tuple] = []
    key, first, parts, size, inner, seen = None, None, [], 0, None, False

    def close(inner_end: bool) -> None:
        """End of a piece; of a whole run that touches no end of the range, its digest."""
        text = ",".join(parts)
        if inner and inner_end:
            out.append((*key, first, hashlib.sha256(text.encode()).hexdigest(), None))
        else:
            out.append((*key, first, None, text))

    def flush() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)
        out.clear()
        return batch

    for batch in batches:
        ex, ey, conv = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("ex", "ey", "conv_id"))
        if not len(conv):
            continue
        starts = np.flatnonzero(np.concatenate([[True], (ex[1:] != ex[:-1]) | (ey[1:] != ey[:-1])]))
        for a, b in zip(starts, [*starts[1:], len(conv)], strict=True):
            own = int(ex[a]), int(ey[a])
            if own != key:
                if key is not None:
                    close(True)
                key, first, parts, size, inner, seen = own, None, [], 0, seen, True
            for at in range(a, b, 10_000):
                if size > PIECE_BYTES:  # a run this long is hashed on from pieces
                    inner = False
                    close(False)
                    yield flush()
                    first, parts, size = None, [], 0
                texts = [str(c) for c in conv[at : min(b, at + 10_000)].tolist()]
                first = int(conv[at]) if first is None else first
                parts += texts
                size += sum(map(len, texts)) + len(texts)
        yield flush()
    if key is not None:
        close(False)
        yield flush()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order of (key, first): one digest a key, without holding more than a batch."""
    key, state = None, None
    for batch in batches:
        done = []
        for ex, ey, piece in zip(*(batch.column(k).to_pylist() for k in ("ex", "ey", "piece")), strict=True):
            if (ex, ey) != key:
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = (ex, ey), hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield _digests(done)
    if key is not None:
        yield _digests([(*key, state.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["ex", "ey", "digest"])


def end_digests(cut: DataFrame) -> DataFrame:
    """(ex, ey, digest): for every node at which conversations end, the digest of their ids in ascending order."""
    ends = cut.groupBy("conv_id").agg(F.bit_xor("x").alias("ex"), F.bit_xor("y").alias("ey"))
    ranged = ends.repartitionByRange("ex", "ey", "conv_id").sortWithinPartitions("ex", "ey", "conv_id")
    pieces = stored(ranged.mapInArrow(_pieces, "ex long, ey long, first long, digest string, piece string"), "ends")
    # Left open are the first and last run of a range, and runs of more than a megabyte.
    open_runs = pieces.filter("digest is null").repartition("ex", "ey").sortWithinPartitions("ex", "ey", "first")
    return pieces.filter("digest is not null").select("ex", "ey", "digest").union(open_runs.mapInArrow(_joined, "ex long, ey long, digest string"))


def trie(turns: DataFrame) -> DataFrame:
    """A row a node, from numbered turns (conv_id, pos, id); conversations without turns have one row of nulls.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, last_turn): the smallest
    member; length of the prefix; the parent's smallest member; members; children; childless nodes of the subtree;
    (members - 1) times the bytes of the last text, summed over the subtree; the digest of the ids of members that end
    here; the id of the last turn.
    """
    cut = stored(blocks(turns), "blocks")
    nodes = stored(_rolled(cut).drop("last"), "nodes")
    owners = nodes.groupBy("rep").agg(F.min(F.struct("depth", "ux", "uy")).alias("top"), F.max("depth").alias("end"), F.sum("saved").alias("tail"))
    owners = owners.select("rep", F.col("top.depth").alias("start"), F.col("top.ux").alias("kx"), F.col("top.uy").alias("ky"), "end", "tail")
    parents = nodes.select("kx", "ky", F.col("rep").alias("above"), (F.col("depth") + 1).alias("start"))
    owners = stored(owners.join(parents, ["kx", "ky", "start"], "left").drop("kx", "ky"), "owners")
    # Tails that hang at a node: its children besides the one that its owner goes on to.
    hanging = owners.filter("above is not null").groupBy(F.col("above").alias("rep"), (F.col("start") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("hanging"))
    hanging = stored(hanging, "hanging")
    leaf = owners.select("rep", "tail", F.col("end").alias("depth")).join(hanging, ["rep", "depth"], "left")
    weights = leaf.select(F.col("rep").alias("conv_id"), "tail", F.col("hanging").isNull().cast("long").alias("leaf"))
    weighed = cut.join(weights, "conv_id", "left").fillna(0, ["tail", "leaf"])
    summed = _running(_rolled(weighed, ("tail", "leaf")), "rep", "depth", "sum", {"above_saved": "saved"})
    full = (
        summed.join(owners.select("rep", "start", "end", "above"), "rep")
        .join(hanging, ["rep", "depth"], "left")
        .join(end_digests(cut).withColumnsRenamed({"ex": "kx", "ey": "ky"}), ["kx", "ky"], "left")
    )
    return full.select(
        F.col("rep").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("start"), F.col("rep")).otherwise(F.col("above")).alias("parent_conv_id"),
        "n_convs",
        (F.coalesce("hanging", F.lit(0)) + (F.col("depth") < F.col("end")).cast("long")).alias("n_children"),
        F.col("leaf").alias("n_leaves"),
        (F.col("tail") - F.col("above_saved")).alias("saved_tokens"),
        F.coalesce("digest", F.lit(EMPTY_DIGEST)).alias("ends_sha256"),
        F.col("last").alias("last_turn"),
    )
