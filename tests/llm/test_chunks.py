"""Content-defined chunking against a byte-by-byte gear hash and brute force."""
import hashlib
import random
from collections import defaultdict

from conftest import SF_SMALL
from tessera.llm import chunks


def plain_ends(data, least=32, most=512, bits=5):
    h, out, last = 0, [], 0
    for i, b in enumerate(data):
        h = (h << 1) + int(chunks.GEAR[b]) & 0xFFFFFFFF
        if i + 1 - last > most:
            last += most
            out.append(last)
        if h >> 32 - bits == 0 and i + 1 - last >= least:
            out.append(i + 1)
            last = i + 1
    while len(data) - last > most:
        last += most
        out.append(last)
    if last < len(data):
        out.append(len(data))
    return out


def alike(a, b, way):
    n = 0
    while n < min(len(a), len(b)) and (a[n] == b[n] if way > 0 else a[-1 - n] == b[-1 - n]):
        n += 1
    return n


def brute(texts, run_bytes=128):
    """The rule chunk by chunk, in plain loops."""
    data = {d: (t or "").encode() for d, t in texts.items()}
    seen, places = defaultdict(list), {d: [] for d in data}
    for d, raw in data.items():
        a = before = 0
        for b in plain_ends(raw):
            h = (b - a >= 32, raw[a:b] if b - a >= 32 else raw[before:b])
            seen[h].append((d, a))
            places[d].append((a, b, h))
            a, before = b, a
    rows = {d: [[a, b, min(seen[h])] for a, b, h in cs if len(seen[h]) > 1] for d, cs in places.items()}
    grow = defaultdict(int)
    for d, rs in rows.items():
        for i, (a, b, kept) in enumerate(rs):
            if kept == (d, a):
                continue
            kd, ka = kept
            if (rs[i - 1][1] if i else 0) < a:
                n = alike(data[d][:a], data[kd][:ka], -1)
                for k in ((d, a, -1), (kd, ka, -1)):
                    grow[k] = max(grow[k], n)
            if i + 1 == len(rs) or rs[i + 1][0] > b:
                n = alike(data[d][b:], data[kd][ka + b - a:], 1)
                for k in ((d, a, 1), (kd, ka, 1)):
                    grow[k] = max(grow[k], n)
    out = {}
    for d, rs in rows.items():
        first = [kept == (d, a) for a, b, kept in rs]
        gaps = [a - (rs[i - 1][1] if i else 0) for i, (a, b, _) in enumerate(rs)] + [len(data[d]) - rs[-1][1] if rs else 0]
        left = [min(grow[d, a, -1], gaps[i]) for i, (a, b, _) in enumerate(rs)]
        right = [min(grow[d, a, 1], gaps[i + 1]) for i, (a, b, _) in enumerate(rs)]
        grown = []
        for i, (a, b, _) in enumerate(rs):
            l_room = gaps[i] - (0 if i and not first[i] and first[i - 1] else right[i - 1] if i else 0)
            r_room = gaps[i + 1] - (left[i + 1] if i + 1 < len(rs) and first[i] and not first[i + 1] else 0)
            grown.append((a - min(left[i], l_room), b + min(right[i], r_room), first[i]))
        runs = []
        for a, b, f in grown:
            if runs and runs[-1][-1][1] == a:
                runs[-1].append((a, b, f))
            else:
                runs.append([(a, b, f)])
        runs = [r for r in runs if r[-1][1] - r[0][0] >= run_bytes or r[-1][1] - r[0][0] == len(data[d])]
        spans = []
        for r in runs:
            for i, (a, b, f) in enumerate(r):
                if f:
                    continue
                if i and not r[i - 1][2]:
                    spans[-1] = (spans[-1][0], b - spans[-1][0])
                else:
                    spans.append((a, b - a))
        out[d] = (len(data[d]), sum(r[-1][1] - r[0][0] for r in runs), sum(n for _, n in spans), spans)
    return out


def got(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_repeated"], r["n_removed"], [tuple(s) for s in r["spans"]]) for r in df.collect()}


def test_ends():
    rng = random.Random(1)
    raw = [bytes(rng.choices(b"abcdefghij klmnop", k=n)) for n in (0, 1, 31, 33, 5000, 700)] + [b"z" * 3000]
    for data, cand in zip(raw, chunks.cut_candidates(raw, 5)):
        assert chunks.chunk_ends(len(data), cand.tolist(), 32, 512) == plain_ends(data)


def test_insertions_move_few_cuts():
    rng = random.Random(2)
    data = bytes(rng.choices(b"abcdefghij klmnop", k=20_000))
    other = data[:500] + b"inserted" + data[500:]
    a = {data[i:j] for i, j in zip([0, *plain_ends(data)], plain_ends(data))}
    b = {other[i:j] for i, j in zip([0, *plain_ends(other)], plain_ends(other))}
    assert len(a & b) > 0.95 * len(a)


def test_documents_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = brute(texts)
    assert got(chunks.whole_repeats(docs)) == want and sum(w[2] > 0 for w in want.values()) > 10


def test_made_texts_match_brute_force(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    pool = [" ".join(word() for _ in range(rng.randint(3, 90))) for _ in range(25)]
    texts = {i: rng.choice(["", " ", "x"]).join(rng.choice(pool)[rng.randrange(30):][:rng.choice([90, 400, 5000])]
                                               for _ in range(rng.randint(1, 6))) for i in range(90)}
    texts |= {900: pool[0] * 40, 901: "y" * 30_000, 902: "z" + "y" * 20_000 + pool[1], 903: None, 904: ""}
    df = spark.createDataFrame([(i, t, 5, i, "d", "k") for i, t in texts.items()],
                               "doc_id long, text string, off int, doc long, digest string, kept string")
    assert got(chunks.whole_repeats(df.repartition(3))) == brute(texts)
    assert chunks.whole_repeats(df.limit(0)).count() == 0


def test_repeated_and_missing_ids(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    a, b, c = text(60), text(70), text(40)
    rows = [(7, a), (7, b), (7, b), (3, b + " " + c), (None, a), (None, None), (None, c), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    res = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in chunks.whole_repeats(df).collect())
    n = {t: len(t) for t in (a, b, c)}
    # null ids come first and keep a and c; id 3 keeps b but for a last chunk that ends there otherwise
    keep = {(0, n[a], 0), (0, 0, 0), (0, n[c], 0), (7, n[a], n[a]), (7, n[b], n[b]), (9, 0, 0)}
    assert keep <= set(res) and len(res) == 8
    assert min(r[2] for r in res if r[:2] == (7, n[b])) >= n[b] - 64
    assert [r for r in res if r[0] == 3][0][2] in range(n[c] - 40, n[c] + 2)


def sound(texts, out):
    """Every removed byte stands in 16 bytes that an earlier place has too."""
    seen, before = set(), b""
    for d in sorted(texts):
        data, (n, repeated, removed, spans) = (texts[d] or "").encode(), out[d]
        assert n == len(data) and removed == sum(k for _, k in spans) and removed <= repeated <= n
        for i in (i for a, k in spans for i in range(a, a + k)):
            near = [(max(i - 15, 0), data[max(i - 15, 0):i + 1]), (i, data[i:i + 16])]
            assert any(p in seen or data.find(p) < s or (len(p) < 16 and p in before) for s, p in near)
        seen |= {data[i:i + 16] for i in range(len(data) - 15)}
        before += b"\0" + data


def test_whole_repeats_of_short_texts_last_chunks_and_passages(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = {i: text(rng.randint(1, 120)) for i in range(60)}
    copies = {100 + i: texts[i] for i in range(60)}
    passages = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(51)) for _ in range(60)]
    shared = {}
    for i, p in enumerate(passages):
        assert len(p) == 305
        shared[200 + 2 * i] = text(rng.randint(5, 40)) + " " + p + " Z" + text(rng.randint(5, 40))
        shared[201 + 2 * i] = text(rng.randint(5, 40)) + "X" + p + "Y" + text(rng.randint(5, 40))
    long = "q" + text(400)
    odd = {500: None, 501: "", 502: "k", 503: "k", 504: "x" * 3000, 505: long, 506: "other " + long, 507: long + " end"}
    texts |= copies | shared | odd
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = got(chunks.whole_repeats(df))
    assert set(out) == set(texts)
    for i in range(60):  # copies are repeats to their last byte
        n = len(texts[i])
        assert out[i][1] == n and out[100 + i] == (n, n, n, [(0, n)])
    whole = sum(out[201 + 2 * i][2] >= 305 and out[200 + 2 * i][1] >= 305 for i in range(60))
    assert whole >= 57  # a few passages hold no chunk that is cut alike in both
    assert not any(out[200 + 2 * i][2] for i in range(60))
    assert out[500][1:] == out[501][1:] == (0, 0, []) and out[502] == (1, 1, 0, []) and out[503] == (1, 1, 1, [(0, 1)])
    assert out[505][1] == len(long) and out[506][2] >= len(long) and out[507][2] == len(long)
    sound(texts, out)
    assert out == brute(texts)


def test_whole_repeats_of_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out, seen = got(chunks.whole_repeats(docs)), set()
    for d in sorted(texts):
        n = out[d][0]
        assert out[d][2] == n if texts[d] in seen and n else True
        seen.add(texts[d])
    sound(texts, out)


def test_query_removes_short_copies(spark, tmp_path):
    from tessera.llm.queries import op5_chunk_dedup
    spark.createDataFrame([(1, "a short text"), (2, "a short text"), (None, "a short text")], "doc_id long, text string") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in op5_chunk_dedup(spark, str(tmp_path)).collect()) == [(0, 0), (1, 12), (2, 12)]


def test_later_growth_shuffles_the_texts_it_needs_only(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame
    rng = random.Random(5)
    texts = {i: "".join(rng.choices("abcdefgh ", k=300)) for i in range(20)}
    texts |= {50: "a" + "y" * 3000, 51: "bc" + "y" * 2000}  # alike over several rounds, cut at other places
    rows = spark.createDataFrame([(d, bytearray(t.encode())) for d, t in texts.items()], "doc long, data binary")
    edges = spark.sql("select 51L as doc, 0L as off, 1 as side, struct(50L as doc, 0L as off) as kept, 2L as at, 1L as kept_at")
    edges = edges.unionByName(spark.sql("select 3L, 0L, 1, struct(4L as doc, 0L as off), 0L, 0L").toDF(*edges.columns))
    plans, plain = [], DataFrame.checkpoint
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, *a, **k: (
        plans.append(df._jdf.queryExecution().optimizedPlan().toString()), plain(df, *a, **k))[1])
    grown = lambda: sorted((r["doc"], r["side"], r["n"]) for r in chunks._grown(rows, edges).collect())
    same = alike(texts[3].encode(), texts[4].encode(), 1)
    assert grown() == [(3, 1, same), (51, 1, 2000)]
    assert len(plans) == 3 and ["LeftSemi" in p for p in plans] == [False, True, True]
    monkeypatch.setattr(chunks, "NAMED", 0)  # more documents than are named: all texts are shuffled
    plans.clear()
    assert grown() == [(3, 1, same), (51, 1, 2000)] and not any("LeftSemi" in p for p in plans)
