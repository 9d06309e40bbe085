"""The prefix trie against a plain dictionary of prefixes, and the radix tree by itself."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from shoplens.llm import prefix_trie
from shoplens.llm.radix import LARGE, RadixTree

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    """Nodes over (conv_id, turn, role, text) rows without ties in turn."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), (role or "", text or "")))
    turns = {c: [t for _, t in sorted(v, key=lambda x: x[0])] for c, v in convs.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(turns.get(c - c % 20, [])[:h] + turns[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        own = (len(members[s]) - 1) * len(re.findall("[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        leaves[s] = sum(leaves[k] for k in kids[s]) or 1
        saved[s] = own + sum(saved[k] for k in kids[s])
    return sorted(((members[s][0], len(s), members[s[:-1]][0] if s else None, len(members[s]), len(kids[s]), leaves[s], saved[s],
                    hashlib.sha256(",".join(map(str, ends[s])).encode()).hexdigest()) for s in members), key=str)


def made(df, **more):
    seqs = prefix_trie.rebuilt(prefix_trie.sequences(df))
    return sorted(map(tuple, prefix_trie.trie(seqs, **more).select(*COLUMNS).collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string, id long, words int, part int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(5)


def conversations(seed, count=400):
    rng = random.Random(seed)
    said = ["", "hello", "hello there", "a b c", None, "é 　 x"]
    rows = []
    for c in rng.sample(range(3 * count), count):
        for i in range(rng.choice([1, 1, 2, 3, 4, 7])):
            rows.append((c, i if rng.random() < .98 or i else None, rng.choice(["user", "assistant", None]),
                         rng.choice(said) if rng.random() < .8 else f"text {rng.randint(0, 9)}"))
    return rows


@pytest.mark.parametrize("per_part", [10, 100_000])
def test_against_plain_prefixes(spark, per_part):
    """Parts of about ten turns: most prefixes are shared by neighbours."""
    rows = conversations(3) + [(None, 0, "user", "no id")]
    assert made(table(spark, rows), turns_per_part=per_part) == plain(rows)


def test_hot_copies_over_many_parts(spark):
    """One sequence held by two thirds of all conversations: its members' ids stream through the digest in order."""
    rows = [(c, i, "user", f"t{i} word") for c in range(1500) for i in range(3)]
    rows += [(c, 0, "user", f"other {c}") for c in range(1500, 1900)]
    rows += [(c, i, "user", f"t{i} word") for c in range(1900, 1950) for i in range(5)]
    assert made(table(spark, rows), turns_per_part=50) == plain(rows)


def test_negative_absent_turnless(spark):
    rows = [(-7, 0, "a", "x"), (-20, 1, "a", "y"), (5, 0, "a", "x"), (41, 3, "b", "z"), (41, 1, "b", None), (60, 0, None, None)]
    got = {r[0]: r for r in made(table(spark, rows)) if r[1] == 0}
    assert got[-20][3] == 5 and got[-20][2] is None
    positive = [r for r in rows if r[0] >= 0]
    assert made(table(spark, positive)) == plain(positive)


def test_long_conversation(spark):
    rows = [(20, i, "user", f"turn {i % 7}") for i in range(3000)] + [(21, i, "user", f"turn {i % 7}") for i in range(2500)]
    assert made(table(spark, rows), turns_per_part=500) == plain(rows)


def test_repeated_rows_and_ties(spark):
    rows = [(20, 1, "u", "same")] * 3 + [(40, 2, "u", "b"), (40, 2, "u", "a")]
    one, two = made(table(spark, rows)), made(table(spark, rows[::-1]))
    assert one == two and max(r[1] for r in one) == 3


def test_no_rows(spark):
    assert made(table(spark, [])) == []
    assert prefix_trie.prefix_trie(table(spark, [(None, 1, "u", "x")])).count() == 0


def test_radix_tree_holds_its_keys():
    rng = random.Random(1)
    keys = {bytes(rng.choices(range(256), k=2 * rng.randint(0, 4))) for _ in range(3000)}
    keys |= {b"\x01\x02" * n for n in range(40)} | {bytes([7, i, 1, 1]) for i in range(256)}
    tree, order = RadixTree(), sorted(keys)
    rng.shuffle(order)
    for k in order:
        tree.insert(k, k)
    ends = [n.end for n, _ in tree.walk() if n.end is not None]
    assert sorted(ends) == sorted(keys)
    assert all(depth == len(n.end) for n, depth in tree.walk() if n.end is not None)
    rooms = {n.room for n, _ in tree.walk()}
    assert rooms >= {4, 256} and all(len(list(n.children())) <= n.room for n, _ in tree.walk())
    assert all(len(list(n.children())) > 1 or n.end is not None for n, _ in tree.walk() if n is not tree.root)   # compressed
    assert all([k.path[0] for k in n.children()] == sorted(k.path[0] for k in n.children())
               for n, _ in tree.walk() if n.room != LARGE or True)


@pytest.mark.parametrize("kids, room", [(4, 4), (5, 16), (16, 16), (17, 48), (48, 48), (49, 256), (256, 256)])
def test_node_layouts_grow(kids, room):
    tree = RadixTree()
    for i in reversed(range(kids)):
        tree.insert(bytes([i, 9]), i)
    assert tree.root.room == room and [n.end for n in tree.root.children()] == list(range(kids))
    assert [tree.root.child(i).end for i in range(kids)] == list(range(kids))
    assert kids == 256 or tree.root.child(255) is None
