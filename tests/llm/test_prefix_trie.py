"""The trie of rebuilt conversations against tuples of turns in a dict."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from groundwell.llm import prefix_trie as trie
from groundwell.llm.prefix_trie import _path_totals, running_sums
from groundwell.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(turns, key=lambda t: t[0])] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        turns = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    below = {}
    for node in sorted(members, key=len, reverse=True):
        kids = [below[k] for k in children[node]]
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below[node] = (sum(k[0] for k in kids) or 1, saved + sum(k[1] for k in kids))
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), *below[node],
                   hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest())
                  for node, m in members.items())


def found(df):
    return sorted(tuple(r) for r in df.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def made(n, turns, kinds):
    return [(c, t, "user" if t % 2 else "system", f"said {(c * 7 + t * t) % kinds}" if t else "hello")
            for c in range(n) for t in range((c * 5) % turns)]


ODD = [
    (0, None, None, None), (0, 3, "user", None), (0, 3, "user", ""), (1, 1, "a", "b"), (1, 1, "a", "b"), (2, 1, "ab", ""),
    (3, 1, "a", "b"), (4, 1, "", "ab"), (None, 1, "user", "nobody"), (11, 2, "user", "no base"), (11, 1, None, "é🙂"),
    (12, 1, "user", "x" * 5_000), (13, 1, "user", "x" * 5_000), (50, 0, "user", "copy"), (55, 0, "user", "copy"),
]


@pytest.mark.parametrize("rows", [made(60, 14, 3), made(40, 12, 1), ODD, made(7, 3, 2)], ids=["mixed", "alike", "odd", "short"])
def test_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(trie, "CHUNK", 4)
    docs = spark.createDataFrame([(*r, 1, "q") for r in rows], SCHEMA + ", depth int, ka string")
    assert found(trie.prefix_trie(docs)) == brute(rows)


def test_one_conversation_of_most_turns(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 16)
    rows = [(5, t, "user", f"t{t % 3}") for t in range(900)] + [(c, t, "user", f"t{t % 3}") for c in (6, 7, 10) for t in range(9)]
    assert found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_no_rows_and_rows_without_conversation(spark):
    assert found(trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    assert found(trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))) == []


def test_a_shared_address_draws_again(spark, monkeypatch):
    first, drawn = trie._addressed, []

    def clashing(conversations, draw):
        drawn.append(draw)
        turns = first(conversations, draw)
        return turns.withColumns({"ref_a": F.lit(1).cast("long"), "ref_b": F.lit(1).cast("long")}) if draw == 0 else turns

    monkeypatch.setattr(trie, "_addressed", clashing)
    rows = made(12, 6, 2)
    assert found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert drawn == [0, 1]


def test_colliding_maps_draw_again(spark, monkeypatch):
    first = trie._bases
    # with multiplier 1 the order of turns is lost, so that (x, y) meets (y, x)
    monkeypatch.setattr(trie, "_bases", lambda draw: [1] * 4 if draw == 0 else first(draw))
    heads = [c for c in range(200) if zlib.crc32(str(c).encode()) % 9 == 0][:2]
    rows = [(heads[0], 0, "a", "x"), (heads[0], 1, "a", "y"), (heads[1], 0, "a", "y"), (heads[1], 1, "a", "x")]
    assert found(trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_running_sums_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = spark.createDataFrame([(k, i, i * k) for k in (1, 2) for i in range(11)], "k long, i long, v long")
    up = {(r.k, r.i): r.sum_v for r in running_sums(rows, "k", "i", ["v"]).collect()}
    down = {(r.k, r.i): r.sum_v for r in running_sums(rows, "k", "i", ["v"], falling=True).collect()}
    for k in (1, 2):
        for i in range(11):
            assert up[k, i] == k * sum(range(i + 1)) and down[k, i] == k * sum(range(i, 11))


def test_totals_of_a_chain_and_a_star_of_paths(spark):
    chain = [(i, i - 1 if i else None, 1) for i in range(20)]
    star = [(100, None, 1)] + [(100 + i, 100, 1) for i in range(1, 30)]
    got = {r.conv_id: r.v for r in _path_totals(
        spark.createDataFrame(chain + star, "conv_id long, up long, v long"), ["v"]).collect()}
    assert all(got[i] == 20 - i for i in range(20)) and got[100] == 30 and got[101] == 1


def test_query_over_the_sample_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert found(op13_prefix_trie(spark, sf_dir)) == brute(rows)
