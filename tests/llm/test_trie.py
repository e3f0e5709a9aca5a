"""The trie of conversations against plain Python, with any splitters, and on odd rows."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest

from tessel.llm import queries
from tessel.llm import trie as T


def plain(rows):
    """The contract for (conv_id, turn, role, text) rows, node by node."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        turns = own.get(c - c % 100, [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append((c, d == len(turns)))
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        found = [p]
        for x in found:
            found += kids.get(x, [])
        return found

    least = {p: min(c for c, _ in m) for p, m in nodes.items()}
    out = []
    for p, m in nodes.items():
        sub = below(p)
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in sub if x)
        ends = ",".join(map(str, sorted(c for c, end in m if end)))
        out.append((least[p], len(p), least[p[:-1]] if p else None, len(m), len(kids.get(p, [])), sum(x not in kids for x in sub), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_rows(seed, convs=300, hot=120):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(["", "a", "é🎉", None, "long " * 9])) for c in range(convs) for t in range(rng.randint(1, 9))]
    rows += [(1000 * c, t, "user", "same") for c in range(10, 10 + hot) for t in range(7)]
    rows += [(7, None, None, None), (7, 3, "x", "tie"), (7, 3, "x", "eit"), (7, 3, "x", "eit"), (None, 1, "u", "no id"), (55, 400, "u", "y" * 200_000)]
    return rows + [(777_700, t, "u", "deep") for t in range(90)] + [(777_800, t, "u", "deep" if t < 70 else "end") for t in range(80)]


@pytest.mark.parametrize("shard_turns, depth_bytes", [(1_000_000, 1 << 26), (200, 1 << 26), (50, 1 << 14)])
def test_trie_equals_plain_python(spark, monkeypatch, shard_turns, depth_bytes):
    monkeypatch.setattr(T, "SHARD_TURNS", shard_turns)
    monkeypatch.setattr(T, "SKELETON_BYTES", depth_bytes)
    rows = random_rows(shard_turns)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn int, role string, text string, path int, key int")
    monkeypatch.setattr(queries, "table", lambda *_: df)
    got = queries.op12_trie(spark, "").collect()
    assert sorted(map(tuple, got), key=str) == plain(rows)
    assert queries.op12_trie(spark, "").columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_no_conversation_and_negative_ids(spark, monkeypatch):
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    monkeypatch.setattr(queries, "table", lambda *_: empty)
    assert queries.op12_trie(spark, "").count() == 0
    turns = T.turns_of(spark.createDataFrame([(-5, 1, "u", "x"), (-5, 0, "u", "y")], empty.schema))
    assert sorted((r.conv_id, r.depth, r.n_leaves) for r in T.trie(turns).collect()) == [(-5, 0, 1), (-5, 1, 1), (-5, 2, 1)]


def test_splitters_leave_all_nodes_but_theirs_local():
    paths = sorted({bytes(random.Random(k).choices(range(2), k=3)) for k in range(9)})
    paths = [b"".join(bytes([x]) * 16 for x in p) for p in paths]
    table = pa.table(dict(shard=[0] * len(paths), path=paths, sizes=[b"\0\0\0\1" * 3] * len(paths), n=[1] * len(paths), conv_id=list(range(len(paths))), ends_sha256=["e"] * len(paths)))
    whole = T.local_nodes(table, [])
    assert not any(whole["skeleton"].to_pylist()) and whole["n_leaves"].to_pylist()[-1] == len(paths)
    part = T.local_nodes(table, [paths[-1][:32] + b"\xff" * 16])
    on = [d for d, s in zip(part["depth"].to_pylist(), part["skeleton"].to_pylist()) if s]
    assert sorted(on) == [0, 1, 2]
