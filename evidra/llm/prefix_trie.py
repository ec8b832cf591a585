"""Prefix trie of conversations rebuilt from a shared head and their own rest, from fingerprints that compose.

A turn has a 64-bit hash; a sequence of turns has the product of its turns in the monoid of pairs (value, length) with
(x, m)(y, n) = (x * B^n + y, m + n) over 64-bit integers. Products of heads and of whole conversations are computed once,
over the stored turns, and the product of a rebuilt prefix follows by algebra: head * (own prefix without own head). No
rebuilt text exists anywhere. A node of the trie is a (depth, product); two things make that exact: every turn hash belongs
to one (role, text), and all members of a node agree on their last turn and on their parent's product. Both are
checked in Spark, and another seed is taken when one fails.

Turns are numbered and multiplied along a range-sorted table, so a conversation of any length is spread over tasks; the
products of the parts before a task are carried in. Subtree sums need no walk over the depth: each node is owned by its smallest
member, a conversation owns the lower end of its path, and sums over subtrees are sums over the members' paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import join_split_hot, materialize
from evidra.session import union_all

BASE = 0xD1342543DE82EF95  # odd, so that every power has an inverse
INVERSE = np.uint64(pow(BASE, -1, 1 << 64))
MAX_HEAD, PIECE_BYTES = 5, 1 << 20


def powers(exponents: np.ndarray) -> np.ndarray:
    out, factor = np.ones(len(exponents), np.uint64), np.uint64(BASE)
    left = exponents.astype(np.uint64)
    with np.errstate(over="ignore"):
        while left.any():
            np.multiply(out, factor, out=out, where=(left & np.uint64(1)).astype(bool))
            left, factor = left >> np.uint64(1), factor * factor
    return out


def joined(head: np.ndarray, tail: np.ndarray, tail_length: np.ndarray) -> np.ndarray:
    """Product of a head and a tail."""
    return head * powers(tail_length) + tail


def tail_of(whole: np.ndarray, head: np.ndarray, tail_length: np.ndarray) -> np.ndarray:
    """The tail whose product with ``head`` is ``whole``."""
    return whole - head * powers(tail_length)


def _u64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def _i64(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, product and text length up to every turn of its conversation, within one task of the sorted table."""
    part, last, held = TaskContext.get().partitionId(), None, (0, np.uint64(0), 0)
    for batch in batches:
        if not batch.num_rows:
            continue
        c, h, size = batch.column("c").to_numpy(), _u64(batch.column("h")), batch.column("len").to_numpy().astype(np.int64)
        at = np.arange(len(c))
        begin = np.maximum.accumulate(np.where(np.diff(c, prepend=c[0]) != 0, at, 0))
        up = powers(at)
        scaled = np.cumsum(h * _inverse_powers(len(at)))
        before = np.where(begin > 0, scaled[begin - 1], np.uint64(0))
        product, number, total = (scaled - before) * up, at - begin + 1, np.cumsum(size)
        total = total - np.where(begin > 0, total[begin - 1], 0)
        if last == c[0]:
            own = begin == 0
            product = np.where(own, joined(np.full(len(c), held[1]), product, number), product)
            number, total = number + held[0] * own, total + held[2] * own
        last, held = c[-1], (int(number[-1]), product[-1], int(total[-1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(c), part, np.int32)), batch.column("c"), _i64(number), _i64(product), _i64(total), batch.column("h"), _i64(size)],
            ["part", "c", "i", "p", "s", "h", "len"])


def _inverse_powers(n: int) -> np.ndarray:
    out = np.full(n, INVERSE, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


def _prefixes(turns: DataFrame) -> DataFrame:
    """(c, i, p, s, h, len): number, product and text length up to each turn, over whole conversations. Staged."""
    ordered = turns.repartitionByRange("c", "t", "h").sortWithinPartitions("c", "t", "h")
    local = materialize(ordered.select("c", "h", "len").mapInArrow(_scan, "part int, c long, i long, p long, s long, h long, len long"))
    # one row per task; a conversation reaches into the next task only if it is the last of its own
    ends = local.groupBy("part").agg(F.min("c").alias("low"), F.max("c").alias("high")).orderBy("part").collect()
    crossing = sorted({a["high"] for a, b in zip(ends, ends[1:], strict=False) if a["high"] == b["low"]})
    if not crossing:
        return local
    spark = turns.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(c,) for c in crossing], "c long"))  # fewer than tasks
    sums = local.join(wanted, "c").groupBy("c", "part").agg(F.max("i").alias("n"), F.max_by("p", "i").alias("p"), F.max("s").alias("s"))
    carried: dict[int, tuple[int, int, int, int]] = {}
    current, n, p, s = None, 0, 0, 0
    for row in sums.orderBy("c", "part").collect():  # two rows per task at most
        if row["c"] != current:
            current, n, p, s = row["c"], 0, 0, 0
        elif n:
            carried[row["part"]] = (row["c"], n, p, s)
        n, p, s = n + row["n"], (p * pow(BASE, row["n"], 1 << 64) + row["p"]) % (1 << 64), s + row["s"]

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, c = batch.column("part").to_numpy(), batch.column("c").to_numpy()
            i, p, s = (batch.column(x).to_numpy() for x in "ips")
            i, p, s = i.copy(), p.view(np.uint64).copy(), s.copy()
            for k in np.unique(part).tolist():
                if k in carried:
                    of, n, head, length = carried[k]
                    here = (part == k) & (c == of)
                    p[here] = joined(np.full(int(here.sum()), head, np.uint64), p[here], i[here])
                    i[here] += n
                    s[here] += length
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("c"), _i64(i), _i64(p), _i64(s), batch.column("h"), batch.column("len")],
                                             batch.schema.names)

    return materialize(local.mapInArrow(carry, local.schema))


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Product of a rebuilt prefix, and of the one before it: head * (own prefix without own head)."""
    for batch in batches:
        steps = batch.column("steps").to_numpy()
        whole, own_head, head, turn = (_u64(batch.column(x)) for x in ("p", "own_head", "head_p", "h"))
        product = joined(head, tail_of(whole, own_head, steps), steps)
        keep = ["c", "d", "h", "len", "rest", "deep"]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keep), _i64(product), _i64((product - turn) * INVERSE)], [*keep, "fp", "up"])


def ordered_digests(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, sha256: of the decimal ``value`` numbers of each key, ascending and joined by commas.

    Rows are range-sorted by key and value. A key inside one task is digested there as a stream; one that reaches a task's border leaves
    text pieces of about a megabyte, which are digested in order. No list of a key's values exists in any task. ``keys`` and
    ``value`` are whole numbers without nulls.
    """
    names = [*keys, "part", "nth", "piece", "sha256"]
    ordered = rows.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col(value).cast("long").alias(value)) \
        .repartitionByRange(*keys, value).sortWithinPartitions(*keys, value)
    width, piece_bytes = len(keys), PIECE_BYTES

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64()] * (width + 2) + [pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*found, strict=True), types, strict=True)], names)

    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, first, nth, hold, size, digest = TaskContext.get().partitionId(), None, True, 0, [], 0, hashlib.sha256()
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            columns = [batch.column(k).to_numpy() for k in keys]
            change = np.flatnonzero(np.any([np.diff(x) != 0 for x in columns], axis=0)) + 1
            numbers = batch.column(value).to_numpy()
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(numbers)], strict=True):
                key = tuple(int(x[a]) for x in columns)
                if key != current:
                    if current is not None:
                        if first:
                            out += [(*current, part, nth, b",".join(hold), None)] * bool(hold)
                        else:
                            digest.update(b",".join(hold))
                            out.append((*current, None, None, None, digest.hexdigest()))
                        first = False
                    current, nth, hold, size, digest = key, 0, [], 0, hashlib.sha256()
                text = ",".join(map(str, numbers[a:b].tolist())).encode()
                hold.append(text)
                size += len(text)
                if size >= piece_bytes:
                    # it may be the last key of the task, which only the end tells: every long key goes out in pieces
                    out.append((*key, part, nth, b",".join(hold), None))
                    first, nth, hold, size = True, nth + 1, [], 0
            if out:
                yield batch_of(out)
        if current is not None and hold:
            yield batch_of([(*current, part, nth, b",".join(hold), None)])

    typed = ", ".join([*(f"`{k}` long" for k in keys), "part long, nth long, piece binary, sha256 string"])
    done = materialize(ordered.mapInArrow(stretch, typed))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, hashlib.sha256()
        for batch in batches:
            out: list[tuple] = []
            for *key, piece in zip(*(batch.column(k).to_pylist() for k in keys), batch.column("piece").to_pylist(), strict=True):
                if key != current:
                    if current is not None:
                        out.append((*current, None, None, None, digest.hexdigest()))
                    current, digest = key, hashlib.sha256(piece)
                else:
                    digest.update(b"," + piece)
            if out:
                yield batch_of(out)
        if current is not None:
            yield batch_of([(*current, None, None, None, digest.hexdigest())])

    pieces = done.where("sha256 is null").repartition(*keys).sortWithinPartitions(*keys, "part", "nth").mapInArrow(finish, typed)
    return done.where("sha256 is not null").unionByName(pieces).select(*keys, "sha256")


def _seeded(turns: DataFrame, seeds: Iterable[int]) -> Iterator[tuple[int, DataFrame]]:
    """Numbered seeds with (c, t, h, len), for those under which a hash names one (role, text)."""
    for seed in seeds:
        hashed = turns.withColumn("h", F.xxhash64(F.lit(seed), "role", "text"))
        if not hashed.select("h", "role", "text").distinct().groupBy("h").count().where("count > 1").limit(1).count():
            yield seed, materialize(hashed.select("c", "t", "h", F.length("text").cast("long").alias("len")))


def trie(turns: DataFrame, base: Callable[[Column], Column], head: Callable[[Column], Column], key: str = "conv_id", turn: str = "turn",
         role: str = "role", text: str = "text", max_head: int = MAX_HEAD, seeds: Iterable[int] = range(1, 9)) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and
    ref_conv, ref_turn: where its last turn is stored (conversation and place from 1).

    Conversation c is rebuilt as the first ``head(c)`` (0 to ``max_head``) turns of conversation ``base(c)``, fewer if it has fewer, and c's
    own turns after its first ``head(c)``. Turns go by ``turn``, nulls first; equal ones by a hash of role and text, and a repeated row is
    a turn again. Null roles and texts are empty. Rows without a conversation are left out; other columns are ignored; an empty
    table has no node. ``key`` is a whole number.
    """
    clean = turns.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("c"), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    for _, hashed in _seeded(clean, seeds):
        prefix = _prefixes(hashed)
        k = head(F.col("c")).cast("long")
        own = prefix.withColumn("k", k).groupBy("c").agg(
            F.max("i").alias("n"), F.max("k").alias("k"), F.max("s").alias("s"),
            F.max(F.when(F.col("i") == F.col("k"), F.col("p"))).alias("own_head"), F.max(F.when(F.col("i") == F.col("k"), F.col("s"))).alias("own_s"))
        own = materialize(own.withColumn("base", base(F.col("c")).cast("long")).fillna(0, ["own_head", "own_s"]))
        tops = prefix.where(F.col("i") <= max_head).join(own.select(F.col("base").alias("c")).distinct(), "c", "left_semi").groupBy(
            F.col("c").alias("base")).agg(F.array_sort(F.collect_list(F.struct("i", "p", "s", "h", "len"))).alias("top"))  # max_head turns at most
        top = F.slice(F.coalesce("top", F.array().cast(tops.schema["top"].dataType)), 1, F.col("k").cast("int"))
        convs = own.join(tops, "base", "left").withColumn("top", top).withColumn("m", F.size("top").cast("long"))
        lead = F.try_element_at("top", F.lit(-1))
        convs = convs.withColumn("head_p", F.coalesce(lead["p"], F.lit(0))).withColumn("head_s", F.coalesce(lead["s"], F.lit(0)))
        convs = materialize(convs.withColumn("deep", F.col("m") + F.greatest(F.col("n") - F.col("k"), F.lit(0))).withColumn(
            "whole", F.col("head_s") + F.when(F.col("n") > F.col("k"), F.col("s") - F.col("own_s")).otherwise(0)))
        n_turns = prefix.count()

        zero = F.lit(0).cast("long")
        late = join_split_hot(prefix.select("c", "i", "p", F.col("s").alias("at"), "h", "len"), convs.drop("top", "s"), ["c"], "n", n_turns).where("i > k").select(
            "c", (F.col("m") + F.col("i") - F.col("k")).alias("d"), "p", "own_head", "head_p", (F.col("i") - F.col("k")).alias("steps"), "h", "len",
            (F.col("whole") - F.col("head_s") - F.col("at") + F.col("own_s") + F.col("len")).alias("rest"), "deep")
        early = convs.select("c", "whole", "deep", F.explode("top").alias("x")).select(
            "c", F.col("x.i").alias("d"), F.col("x.p").alias("p"), zero.alias("own_head"), zero.alias("head_p"), F.col("x.i").alias("steps"),
            F.col("x.h").alias("h"), F.col("x.len").alias("len"), (F.col("whole") - F.col("x.s") + F.col("x.len")).alias("rest"), "deep")
        composed = union_all([late, early]).mapInArrow(_compose, "c long, d long, h long, len long, rest long, deep long, fp long, up long")
        root = convs.select("c", zero.alias("d"), zero.alias("h"), zero.alias("len"), F.col("whole").alias("rest"), "deep", zero.alias("fp"), zero.alias("up"))
        rows = materialize(composed.unionByName(root))
        single = [x for c in ("h", "up") for x in (F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high"))]
        nodes = materialize(rows.groupBy("d", "fp").agg(
            F.count("*").alias("n_convs"), F.min("c").alias("first"), F.max("deep").alias("deepest"), *single))
        if not nodes.where("h_low != h_high or up_low != up_high").limit(1).count():
            return _summed(rows, nodes.drop("h_low", "h_high", "up_low", "up_high"), convs, key)
    raise ValueError("turns or prefixes share a hash under all seeds")


def _summed(rows: DataFrame, nodes: DataFrame, convs: DataFrame, key: str) -> DataFrame:
    """The nodes with their sums. ``rest`` of a row is the text length from its depth to the conversation's end."""
    total = rows.count()
    met = materialize(join_split_hot(rows.select("c", "d", "fp", "rest", "deep"), nodes, ["d", "fp"], "n_convs", total).drop("fp"))
    owned = F.col("first") == F.col("c")
    # a conversation owns its path from ``since`` down; the nodes above belong to smaller members, the nearest being the largest
    paths = met.groupBy("c").agg(
        F.count("*").alias("rows"), F.min(F.when(owned, F.col("d"))).alias("since"), F.max(F.when(~owned, F.col("first"))).alias("above"),
        F.max(F.when(owned, F.col("rest"))).alias("owned_rest"),
        F.max((owned & (F.col("d") == F.col("deep")) & (F.col("deepest") == F.col("d"))).cast("long")).alias("leaf"))
    paths = paths.fillna({"since": 1 << 62, "owned_rest": 0}).join(convs.select("c", "base", "m", "k"), "c")
    joined_ = join_split_hot(met, materialize(paths), ["c"], "rows", total)
    inherited = F.col("d") <= F.col("m")

    def of_owner(value: Column) -> Column:
        return F.max(F.when(owned & (F.col("d") > 0), value))

    sums = joined_.groupBy("first", "d").agg(
        of_owner(F.when(F.col("d") > F.col("since"), F.col("c")).otherwise(F.col("above"))).alias("parent_conv_id"), F.max("n_convs").alias("n_convs"),
        F.sum(((F.col("d") < F.col("deep")) & (F.col("since") <= F.col("d") + 1)).cast("long")).alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(F.col("d") < F.col("since"), F.col("rest") - F.col("owned_rest")).otherwise(0)).alias("saved_tokens"),
        of_owner(F.when(inherited, F.col("base")).otherwise(F.col("c"))).alias("ref_conv"),
        of_owner(F.when(inherited, F.col("d")).otherwise(F.col("d") - F.col("m") + F.col("k"))).alias("ref_turn"))
    ends = ordered_digests(met.where("d = deep").select("first", "d", "c"), ["first", "d"], "c")
    return sums.join(ends, ["first", "d"], "left").select(
        F.col("first").alias(key), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "ref_conv", "ref_turn")


def hundred(conv: Column) -> Column:
    """The conversation that opens the hundred of ``conv``."""
    return conv - conv % 100


def head_length(conv: Column) -> Column:
    return F.crc32(conv.cast("string")) % 6


def trie_sql() -> str:
    """The trie in SQL: prefixes as hashes of joined texts, sums over the paths of the smallest members."""
    step = "list_concat([CAST(ascii(x) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])"
    crc = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: {step}))),
                    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x >> 1, 3988292384::BIGINT * (x & 1)) END), 4294967295::BIGINT)"""
    return f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
     c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
     heads AS (SELECT c.conv_id, t.i AS d, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h),
     m AS (SELECT conv_id, count(*) AS m FROM heads GROUP BY conv_id),
     own AS (SELECT c.conv_id, coalesce(m, 0) + t.i - c.h AS d, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h
             LEFT JOIN m ON m.conv_id = c.conv_id),
     r AS (SELECT * FROM heads UNION ALL SELECT * FROM own),
     p AS (SELECT conv_id, d, length(text) AS size,
                  md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS k FROM r
           UNION ALL SELECT conv_id, 0, 0, '' FROM c),
     e AS (SELECT conv_id, max(d) AS deep FROM p GROUP BY conv_id),
     n AS (SELECT d, k, min(conv_id) AS first, count(*) AS n_convs, max(deep) AS deepest, max(size) AS size,
                  coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = deep), '') AS finals
           FROM p JOIN e USING (conv_id) GROUP BY d, k),
     up AS (SELECT n.d, n.k, q.k AS parent FROM n JOIN p AS q ON q.conv_id = n.first AND q.d = n.d - 1),
     kids AS (SELECT d - 1 AS d, parent AS k, count(*) AS n_children FROM up GROUP BY ALL),
     sums AS (SELECT a.d, a.k, count(*) FILTER (WHERE n.deepest = n.d) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved
              FROM n JOIN p AS a ON a.conv_id = n.first AND a.d <= n.d GROUP BY a.d, a.k)
SELECT n.first AS conv_id, CAST(n.d AS BIGINT) AS depth, q.first AS parent_conv_id, n.n_convs, CAST(coalesce(n_children, 0) AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(n.finals) AS ends_sha256
FROM n LEFT JOIN up ON up.d = n.d AND up.k = n.k LEFT JOIN n AS q ON q.d = n.d - 1 AND q.k = up.parent
LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k JOIN sums ON sums.d = n.d AND sums.k = n.k
"""
