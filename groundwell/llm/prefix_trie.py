"""The trie of all prefixes of rebuilt conversations, by composable fingerprints.

A conversation is rebuilt from the first turns of another one and its own turns after as many.  Its texts are never
put together.  A turn is the affine map x -> B x + t over a few prime fields, t from its content; a sequence of turns is
the composition of their maps, and compositions form a monoid: the fingerprint of a rebuilt prefix is the product of
the head of the one conversation and a stretch of the other, where a stretch is the quotient of two prefixes.  Since
B is fixed, a product is kept as the sum of t_i B^i, and prefixes of stored conversations are running sums.

Prefixes with equal fingerprints are one node.  Every row keeps a reference to its last stored turn: a content
address, of which a comparison of the texts themselves shows that no two different turns share one.  A node is
verified by its members' references and by their parents being one node, which by induction on depth makes the
sequences equal; if a check fails, other maps are drawn.

Sums over subtrees take no walk by levels: the nodes with the same smallest member are a path of the trie, totals of
paths climb by doubling strides over the tree of paths, and inside a path they are running sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundwell.operators.numbering import numbered_by_range
from groundwell.session import settle

PRIMES = [2147483647, 2147483629, 2147483587, 2147483579]  # the largest below 2^31: products fit in a long
CHUNK = 4096  # places of a conversation, or ids of a list, that are handled in one go
HEAD = 8  # no rebuilt conversation takes more turns from another one
GROUP = 5  # conversations that take their head from one
NODE = ["depth", "ka", "kb"]


def _bases(draw: int) -> list[int]:
    """A multiplier for each prime; another draw gives others."""
    return [int.from_bytes(hashlib.sha256(f"{draw}-{p}".encode()).digest()[:8], "big") % (p - 2) + 2 for p in PRIMES]


def _power(exponent: Column, base: int, prime: int) -> Column:
    """base ** exponent modulo prime, for exponents from 0 to 2^32 - 1."""
    out = F.lit(1).cast("long")
    for byte in range(4):
        step = pow(base, 1 << 8 * byte, prime)
        table = F.lit([pow(step, k, prime) for k in range(256)])
        out = out * F.get(table, F.shiftright(exponent, 8 * byte).bitwiseAND(F.lit(255)).cast("int")) % prime
    return out


def running_sums(rows: DataFrame, key: str, at: str, values: list[str], falling: bool = False,
                 along: DataFrame | None = None) -> DataFrame:
    """Adds ``sum_<value>``: the sum over the rows of the key at or before the row's place (after, if falling).

    Places of a key differ.  Sums are made inside chunks of places and over the chunks before, so a key of any size is
    many groups.  Columns of ``along`` (one row per key) are put beside each row.
    """
    cut = rows.withColumn("chunk", F.floor(F.col(at) / CHUNK).cast("long"))
    order = (lambda c: F.col(c).desc()) if falling else F.col
    before = Window.partitionBy(key).orderBy(order("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "chunk").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0)
    offsets = cut.groupBy(key, "chunk").agg(*[F.sum(v).alias(f"all_{v}") for v in values]).select(
        key, "chunk", *[F.coalesce(F.sum(f"all_{v}").over(before), F.lit(0)).alias(f"off_{v}") for v in values])
    if along is not None:
        offsets = offsets.join(along, key)
    summed = cut.join(offsets, [key, "chunk"]).withColumns(
        {f"sum_{v}": F.sum(v).over(inside) + F.col(f"off_{v}") for v in values})
    return summed.drop("chunk", *[f"off_{v}" for v in values])


def _addressed(conversations: DataFrame, draw: int) -> DataFrame:
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), F.xxhash64(F.lit(2 * draw), role, text).alias("ref_a"),
        F.xxhash64(F.lit(2 * draw + 1), text, role).alias("ref_b"), F.octet_length(text).cast("long").alias("n_bytes"),
    ).where("conv_id is not null")


def _shared_address(turns: DataFrame) -> bool:
    """Do two different turns have the same address?  Compares roles and texts as they are."""
    different = turns.select("ref_a", "ref_b", "role", "text").distinct()
    return not different.groupBy("ref_a", "ref_b").count().where("count > 1").isEmpty()


def _members(turns: DataFrame, draw: int) -> DataFrame:
    """One row for each rebuilt prefix: conv_id, depth, its fingerprint and its parent's, its last turn, whether it is
    the whole conversation."""
    bases, fields = _bases(draw), range(len(PRIMES))
    at = numbered_by_range(turns.drop("role", "text"), ["conv_id"], ["turn", "ref_a", "ref_b"], "number")
    at = at.select("conv_id", (F.col("number") - 1).alias("i"), "ref_a", "ref_b", "n_bytes", *[
        (F.pmod(F.xxhash64(F.lit(draw), F.lit(m), "ref_a", "ref_b"), F.lit(PRIMES[m]))
         * _power(F.col("number") - 1, bases[m], PRIMES[m]) % PRIMES[m]).alias(f"w{m}") for m in fields])
    at = settle(at, "trie-turns")
    w = [f"w{m}" for m in fields]

    first = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)  # HEAD rows at most
    heads = at.where(F.col("i") < HEAD).select(
        F.col("conv_id").alias("of"), (F.col("i") + 1).alias("k"), "ref_a", "ref_b", "n_bytes",
        *[(F.sum(f"w{m}").over(first) % PRIMES[m]).alias(f"f{m}") for m in fields],
        *[((F.sum(f"w{m}").over(first) - F.col(f"w{m}")) % PRIMES[m]).alias(f"e{m}") for m in fields])
    heads = settle(heads, "trie-heads")

    c = F.col("conv_id")
    sizes = at.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id", "n", (F.crc32(c.cast("string").cast("binary")) % (HEAD + 1)).alias("h"), (c - c % GROUP).alias("base"))
    prefixes = heads.select("of", "k", *[f"f{m}" for m in fields])
    lent = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = sizes.join(lent, "base", "left").withColumn(
        "taken", F.least("h", F.coalesce("n_base", F.lit(0))))
    for name, of, k in (("head", "base", "taken"), ("skip", "conv_id", "h")):
        side = prefixes.select(F.col("of").alias(of), F.col("k").alias(k),
                               *[F.col(f"f{m}").alias(f"{name}{m}") for m in fields])
        convs = convs.join(side, [of, k], "left")
    # B^(taken - h) moves a stretch from its own place to the place it has in the rebuilt conversation
    back = [F.get(F.lit([pow(bases[m], -k, PRIMES[m]) for k in range(HEAD + 1)]), (F.col("h") - F.col("taken")).cast("int"))
            for m in fields]
    zero = F.lit(0)
    convs = settle(convs.select(
        "conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), zero)).alias("length"),
        *[back[m].alias(f"r{m}") for m in fields],
        *[F.pmod(F.coalesce(f"head{m}", zero) - back[m] * F.coalesce(f"skip{m}", zero) % PRIMES[m],
                 F.lit(PRIMES[m])).alias(f"s{m}") for m in fields]), "trie-conversations")

    def shaped(rows: DataFrame, depth: Column, own: list[Column], parent: list[Column] | None) -> DataFrame:
        def two(k: list[Column], names: tuple[str, str]) -> list[Column]:
            return [(F.shiftleft(k[2 * j], 31) + k[2 * j + 1]).alias(names[j]) for j in (0, 1)]

        none = F.lit(None).cast("long")
        return rows.select(
            "conv_id", depth.alias("depth"), *two(own, ("ka", "kb")),
            *(two(parent, ("pa", "pb")) if parent else [none.alias("pa"), none.alias("pb")]),
            *([F.col(x) for x in ("ref_a", "ref_b", "n_bytes")] if parent else
              [none.alias("ref_a"), none.alias("ref_b"), F.lit(0).cast("long").alias("n_bytes")]),
            (depth == F.col("length")).alias("whole"))

    along = convs.select("conv_id", "h", "taken", "length", *[f"{x}{m}" for x in "rs" for m in fields])
    own = running_sums(at, "conv_id", "i", w, along=along).where("i >= h")
    own_key = [(F.col(f"s{m}") + F.col(f"r{m}") * (F.col(f"sum_w{m}") % PRIMES[m])) % PRIMES[m] for m in fields]
    own_parent = [F.pmod(own_key[m] - F.col(f"r{m}") * F.col(f"w{m}") % PRIMES[m], F.lit(PRIMES[m])) for m in fields]
    tails = shaped(own, F.col("taken") + F.col("i") + 1 - F.col("h"), own_key, own_parent)
    borrowed = convs.join(heads.withColumnRenamed("of", "base"), "base").where("k <= taken")  # GROUP x HEAD rows a base
    borrowed = shaped(borrowed, F.col("k"), [F.col(f"f{m}") for m in fields], [F.col(f"e{m}") for m in fields])
    roots = shaped(convs, F.lit(0).cast("long"), [F.lit(0).cast("long") for _ in fields], None)
    return settle(tails.unionByName(borrowed).unionByName(roots), "trie-members")


def _nodes(members: DataFrame) -> DataFrame:
    """One row for each node, with the smallest and the largest of what its members must agree in."""
    agreed = ["pa", "pb", "ref_a", "ref_b", "n_bytes"]
    return settle(members.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(x).alias(x) for x in agreed],
        F.coalesce(F.expr(" or ".join(f"max({x}) <> min({x})" for x in agreed)), F.lit(False)).alias("differs")),
        "trie-nodes")


def _digests(members: DataFrame) -> DataFrame:
    """(node, ends_sha256) over the sorted ids of the conversations that end at a node.

    Ids are joined in pieces of ``CHUNK`` neighbouring numbers; a digest then reads its pieces in order, one at a time.
    """
    c = F.col("conv_id")
    pieces = members.where("whole").groupBy(*NODE, F.floor(c / CHUNK).cast("long").alias("piece")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x.cast("string")), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([d[k] for d in done], pa.int64()) for k in range(3)] + [pa.array([d[3] for d in done], pa.string())],
                [*NODE, "ends_sha256"])

        for batch in batches:
            for *node, ids in zip(*(batch.column(name).to_pylist() for name in (*NODE, "ids"))):
                if node != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield out()
                done = []
        if now is not None:
            done.append((*now, digest.hexdigest()))
            yield out()

    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece")
    return ordered.mapInArrow(run, "depth long, ka long, kb long, ends_sha256 string")


def _path_totals(paths: DataFrame, values: list[str]) -> DataFrame:
    """``values`` of each path added up over all paths that hang below it (conv_id, up: the path it hangs from).

    In every round a path hands what it has to the one a stride above and doubles its stride, so a tree of paths of
    any depth takes a logarithm of rounds.
    """
    state = paths.select("conv_id", "up", *values)
    while True:
        state = settle(state, "trie-paths")
        climbing = state.where("up is not null")
        if climbing.isEmpty():
            return state.drop("up")
        gained = climbing.groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        above = state.where("up is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        state = state.join(gained, "conv_id", "left").join(above, "up", "left").select(
            "conv_id", F.col("next").alias("up"),
            *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations of ``conversations`` (conv_id, turn, role, text).

    Conversation c takes the first h = crc32(decimal c) % 9 turns of conversation c - c % 5 (all of them if there are
    fewer, none if it is absent), then its own turns after its first h.  Turns are ordered by ``turn``, null first;
    equal numbers by content address.  A null role or text is empty; rows without a conv_id belong to no conversation
    and are left out.  Repeated rows are turns of their own.  A conversation with no turns left is a member of the
    root only.  Texts are compared whole, other columns ignored.  An empty table has no conversations and no nodes.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens
    (bytes of last texts, times the members but one, over the subtree), ends_sha256 (ids that end here, ascending).
    """
    for draw in count():
        turns = _addressed(conversations, draw)
        if _shared_address(turns):
            continue
        members = _members(turns, draw)
        nodes = _nodes(members)
        if nodes.where("differs").isEmpty():
            break
    ends = _digests(members)
    parent = nodes.select((F.col("depth") + 1).alias("depth"), F.col("ka").alias("pa"), F.col("kb").alias("pb"),
                          F.col("conv_id").alias("parent_conv_id"))
    tied = nodes.join(parent, ["depth", "pa", "pb"], "left").join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    tied = settle(tied, "trie-tied")
    children = tied.where("depth > 0").groupBy(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    tied = tied.join(children, ["conv_id", "depth"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    tied = settle(tied, "trie-children")
    paths = settle(tied.groupBy("conv_id").agg(
        F.min_by("parent_conv_id", "depth").alias("up"), (F.min("depth") - 1).alias("fork"), F.sum("leaf").alias("leaf"),
        F.sum("saved").alias("saved")), "trie-paths")
    below = _path_totals(paths, ["leaf", "saved"])
    hung = below.join(paths.select("conv_id", "up", "fork"), "conv_id").where("up is not null").groupBy(
        F.col("up").alias("conv_id"), F.col("fork").alias("depth")).agg(
        F.sum("leaf").alias("more_leaf"), F.sum("saved").alias("more_saved"))
    local = tied.join(hung, ["conv_id", "depth"], "left")
    for v in ("leaf", "saved"):
        local = local.withColumn(v, F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).drop(f"more_{v}")
    return running_sums(local, "conv_id", "depth", ["leaf", "saved"], falling=True).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("sum_leaf").alias("n_leaves"),
        F.col("sum_saved").alias("saved_tokens"), "ends_sha256")
