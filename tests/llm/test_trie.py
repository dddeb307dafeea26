"""Prefix nodes of conversations against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import pytest

from vitalspan.llm import trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, name string, n long"


def frame(spark, made):
    return spark.createDataFrame([(*r, "x", 7) for r in made], SCHEMA)


def turn_name(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(made):
    own = {}
    for c, turn, role, text in made:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, turn_name(role or "", text or ""), role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    out = []
    for path in members:
        below = [p for p in members if p[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in members[path] if len(whole[c]) == len(path))))
        out.append(
            (
                min(members[path]),
                len(path),
                min(members[path[:-1]]) if path else None,
                len(members[path]),
                len(kids.get(path, [])),
                sum(p not in kids for p in below),
                sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def got(spark, made, **bounds):
    return sorted((tuple(r) for r in trie.prefix_nodes(frame(spark, made), **bounds).select(*COLUMNS).collect()), key=str)


def some(seed, convs, longest):
    draw = random.Random(seed)
    made = []
    for c in draw.sample(range(1500), convs):
        for t in range(draw.randrange(0, longest)):
            made.append((c, t, draw.choice(["user", "assistant", None]), draw.choice(["", None, "a", "bé", "𝒳y"])))
    draw.shuffle(made)
    return made


@pytest.mark.parametrize("seed", range(2))
def test_nodes_are_those_of_a_dictionary(spark, seed):
    made = some(seed, 150, 9)
    assert got(spark, made) == brute(made)


def test_stretches_and_tries_of_bounded_size(spark):
    """Long conversations in stretches of four turns, tries handed on at ten depths."""
    made = some(5, 25, 40) + [(3, t, "user", "a") for t in range(60)] + [(4, t, "user", "a") for t in range(50)]
    assert got(spark, made, stretch=4, depths=10, piece_ids=3) == brute(made)


def test_edges(spark):
    assert got(spark, []) == []
    made = [(1, None, None, None), (1, None, None, None), (1, 2, "user", "x"), (1, 2, "user", "x"), (1, 2, "user", "w"), (None, 1, "user", "lost")]
    made += [(c, 0, "user", "same") for c in range(100, 140)] + [(205, 0, "user", "z" * 300_000)] + [(c, 0, "a", "t") for c in (301, 302)]
    assert got(spark, made) == brute(made)


def test_fat_search_finds_every_exit_node():
    draw = random.Random(3)
    for _ in range(200):
        made = trie.ZFastTrie()
        paths = []
        for k in range(draw.randrange(1, 30)):
            turns = [draw.choice("ab") for _ in range(draw.randrange(0, 20))]
            paths.append([b"".join(t.encode() for t in turns[:d]) for d in range(len(turns) + 1)])
            made.insert(paths[-1], [1] * len(turns), 0, k, [1])
        for path in paths:
            node = made.exit_node(path)
            assert made.path[node][: made.high[node] + 1] == path and made.high[node] == len(path) - 1
        names = sorted(row[0] for row in made.expanded() if row[2])
        assert names == sorted({p for path in paths for p in path[1:]})


def test_fattest():
    assert [trie.fattest(a, b) for a, b in ((0, 1), (0, 7), (2, 7), (4, 7), (8, 16), (5, 6))] == [1, 4, 4, 6, 16, 6]
