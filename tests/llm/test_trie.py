"""Conversation trie against brute force, queues and shards against plain sums."""
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd

from conftest import SF_SMALL
from tessera.llm import queries, trie
from tessera.plans.oracle_check import compare

COLUMNS = "conv_id long, turn long, role string, text string"


def conversations(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            out.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [t[2:] for t in sorted(ts)] for c, ts in out.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, cs in members.items():
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, cs in members.items():
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(cs) - 1) * words
    out = {}
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(p))
        out[min(cs), len(p)] = (min(members[p[:-1]]) if p else None, len(cs), kids.get(p, 0), leaves[p], saved[p],
                                hashlib.sha256(ends.encode()).hexdigest())
    return out


def got(df):
    rows = df.collect()
    out = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in rows}
    assert len(out) == len(rows)
    return out


def made(seed, n, ids=200):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-30, ids), n):
        for t in range(rng.choice([1, 1, 2, 3, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t > 1 else "user", "hi there" if rng.random() < .6 else f"w{rng.randrange(3)} x"))
    return rows


def test_table_matches_brute_force_and_sql(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = queries.op11_prefix_trie(spark, SF_SMALL)
    assert got(out) == brute(rebuilt(conversations(rows)))


def test_shards_below_shards(spark):
    rows = made(1, 150)
    for i in range(40):  # one long path that many conversations leave
        rows += [(1000 + i, t, "user", f"deep {t}" if t < 3 * i else f"own {i} {t}") for t in range(3 * i + 5)]
    df = spark.createDataFrame(rows, COLUMNS)
    turns = trie.ordered_turns(df)
    ids = turns.select("conv_id").distinct()
    want = brute(conversations(rows))
    assert got(trie.prefix_trie(turns, ids, shard_rows=40, held=8)) == want  # shard roots are sharded again
    assert got(trie.conversation_trie(df)) == want


def test_odd_rows(spark, tmp_path):
    rows = made(2, 60) + [(None, 1, "user", "x"), (None, None, None, None), (40, None, "user", None), (41, None, None, "a b c \t d"),
                          (41, 3, "user", ""), (41, 3, "user", ""), (41, 3, "admin", "z"), (60, 0, "user", "long " * 50_000),
                          (61, 0, "user", "long " * 50_000), (-9223372036854775808, 0, "user", "q"), (9223372036854775807, 0, "user", "q")]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], COLUMNS + ", depth int, key string")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    want = brute(rebuilt(conversations(rows)))
    assert got(queries.op11_prefix_trie(spark, str(tmp_path))) == want
    odd = df.selectExpr("cast(conv_id as bigint) as `c.id`", "turn as piece", "role as words", "text as `my text`")
    names = dict(conv_col="c.id", turn_col="piece", role_col="words", text_col="my text")
    assert got(trie.conversation_trie(odd, **names)) == brute(conversations(rows))
    assert trie.conversation_trie(df.limit(0)).count() == 0
    only = spark.createDataFrame([(3, 0, "user", "x"), (3, 1, "user", "y")], COLUMNS)
    turns, ids = trie.rebuilt_turns(trie.ordered_turns(only))  # h = 3 and no conversation 0: no turns
    assert zlib.crc32(b"3") % 4 >= 2 and got(trie.prefix_trie(turns, ids)) == brute({3: []})


def test_queue_spills_and_sums(tmp_path):
    rng, plain = random.Random(3), {}
    queue = trie.MessageQueue(str(tmp_path), 2, held=16)
    now, seen = (0, 0), {}
    for _ in range(300):
        n = rng.randrange(12)
        level = [now[0] + rng.randrange(1, 4) for _ in range(n)]
        name = [rng.randrange(-20, 20) for _ in range(n)]
        for k in zip(level, name):
            plain[k] = plain.get(k, 0) + 1
        queue.push(np.array(level, np.int64), np.array(name, np.int64), np.ones((n, 2), np.int64))
        now = max(now, (now[0] + rng.choice([0, 0, 1]), rng.randrange(-20, 20)))
        for m in queue.pop(*now):
            seen[int(m["level"]), int(m["name"])] = int(m["load"][1])
            assert (m["level"], m["name"]) <= now
        assert seen == {k: v for k, v in plain.items() if k <= now}
    assert queue.made > 3


def test_up_pass_streams_batches():
    nodes = pd.DataFrame([(0, d, c, 0 if d else 0, d - 1, int(d == 3 or c > 0), 1) for c in range(50) for d in range(4 if c == 0 else 1, 4 if c == 0 else 2)]
                         + [(0, d, 0, 0, d - 1, int(d == 3), 1) for d in range(4)],
                         columns=["shard", *trie.NODE, "n", "one"])
    nodes["parent_depth"], nodes["root_conv"], nodes["root_depth"] = nodes["depth"] - 1, 0, 0
    nodes = nodes.drop_duplicates(["conv_id", "depth"]).sort_values(["depth", "conv_id"], ascending=[False, True])
    batches = [nodes.iloc[i:i + 7] for i in range(0, len(nodes), 7)]
    out = pd.concat(trie._up(["n", "one"], False, held=4)(iter(batches)))
    root = out[(out["depth"] == 0)].iloc[0]
    assert root["one"] == len(nodes) and root["n"] == nodes["n"].sum()
