"""Importance resampling, token counts and conversation repair: against brute force, and on nulls, empty tables, ties and clashing columns."""

import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from storyspark.llm import conversation_repair, resample, token_counts

SF = "/root/testdata/sf0.001"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# 11 -----------------------------------------------------------------------------------------------------------------
def resampled(docs, target, orders=(1,), least=20, percent=10):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        runs = [" ".join(words[i : i + k]) for k in orders for i in range(len(words) - k + 1)]
        return len(words), [zlib.crc32(x.encode()) % 10000 for x in runs]

    made, aim = [(i, *features(t)) for i, t in docs], [b for t in target for b in features(t)[1]]
    s, t = np.zeros(10000, int), np.bincount(np.array(aim, int), minlength=10000)
    for _, _, b in made:
        s += np.bincount(np.array(b, int), minlength=10000)
    gain = [math.floor(1000 * math.log((int(y) + 1) * (int(s.sum()) + 10000) / ((int(x) + 1) * (int(t.sum()) + 10000)))) for x, y in zip(s, t)]
    out = []
    for i, n, b in made:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        out.append([i, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize("orders", [(1,), (1, 2), (2, 3)])
def test_resample_brute(spark, orders):
    docs, target = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/benchmark.parquet")
    got = resample.resample(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").select("text"), orders)
    assert rows_of(got, "doc_id", *resample.COLUMNS) == resampled(list(zip(docs.doc_id, docs.text)), list(target.text), orders)


def test_resample_edges(spark, docs, empty):
    aim = spark.createDataFrame([("The Bank of the river ÉTÉ.",), (None,)], "text string")
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = resample.resample(docs, aim, min_words=1, percent=70)
    assert got.columns == ["doc_id", "text", "lang", "n_features", "weight", "score", "rank"]
    want = resampled(data, ["The Bank of the river ÉTÉ.", None], least=1, percent=70)
    fixed = lambda rows: sorted((r[:4] for r in rows), key=str)
    assert fixed(rows_of(got, "doc_id", *resample.COLUMNS)) == fixed(want)
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == [1, 2, 3, 4, 5]
    assert resample.resample(empty, aim).count() == 0
    assert resample.resample(docs, aim.limit(0), percent=0).where("rank is not null").count() == 0
    # ties of copies under one id share a score and get successive ranks
    twins = spark.createDataFrame([(1, "a b")] * 4 + [(2, "a b")] * 2, "doc_id long, text string")
    assert sorted(r["rank"] for r in resample.resample(twins, aim, min_words=2, percent=100).collect()) == [1, 2, 3, 4, 5, 6]


def test_resample_plan(spark):
    """Scoring neither explodes nor shuffles: the gains are one literal."""
    col = resample.literal([1, 2, 3])
    plan = spark.range(3).select(col.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and "[1,2,3]" in plan


# 12 -----------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def pieces():
    return token_counts.PieceCounts(None)


def test_token_counts_brute(spark, pieces):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    n = pieces.whole([t or "" for t in docs.text])
    want = sorted(((i, len((t or "").encode()), k, k > 4096) for i, t, k in zip(docs.doc_id, docs.text, n)), key=str)
    assert rows_of(token_counts.op12_token_counts(spark, SF), "doc_id", *token_counts.COLUMNS) == want


def test_token_counts_odd_texts(spark, pieces):
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "▁", "a", "the", "19", "é", "中", "😀", "\x00", "<s>", "</s>", "<unk>", "<0x0A>", ".", "\r", " ", "　", "ﬁ"]
    texts = ["", " ", "  ", "\n", " \n ", "a\n", "\na", "▁", "x▁▁y", "x" * 50_000, " " * 5_000, "中 " * 3_000]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = pieces.whole(texts)
    for frequent in (None, (np.zeros(0, np.uint64), np.zeros(0, np.uint16))):
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, frequent=frequent).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_token_counts_edges(spark, docs, empty):
    clash = docs.withColumnRenamed("score", "N_TOKENS")
    got = token_counts.count_tokens(clash, limit=29_999)
    assert got.columns == ["doc_id", "text", "lang", "n_bytes", "n_tokens", "over_limit"] and got.count() == docs.count()
    rows = {r["doc_id"]: r for r in got.collect()}
    assert (rows[3]["n_bytes"], rows[3]["n_tokens"], rows[4]["n_tokens"]) == (0, 0, 0)
    assert rows[8]["n_tokens"] == 30_001 and rows[8]["over_limit"] and not rows[1]["over_limit"]
    assert token_counts.count_tokens(empty).count() == 0


def test_token_counts_small_memory(spark, pieces, monkeypatch):
    """Forgetting caches and pruned summaries change no count."""
    for name, value in (("KEPT", 3), ("SUMMARY", 2)):
        monkeypatch.setattr(token_counts, name, value)
    df = spark.createDataFrame([("a b c a b a d e f g h i j k a a a",)], "text string")
    keys, n = token_counts.frequent_table(df)
    assert len(keys) <= 2 and (n == 1).all()
    w = token_counts.Worker(None)
    monkeypatch.setattr(token_counts, "CACHED", 1)
    import pyarrow as pa

    for text in ("one two three", "four five six one", "two\ntwo"):
        assert w.count(pa.array([text]), (keys, n)).tolist() == pieces.whole([text])


# 13 -----------------------------------------------------------------------------------------------------------------
def repaired(rows):
    """Every conversation by best-first search over (cost, audit)."""
    convs: dict = {}
    for c, t, r, x in rows:
        convs.setdefault(c, [])
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        convs[c] += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    leads = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    out = []
    for c, rs in convs.items():
        rs.sort(key=lambda z: (z[0] is not None, z[0] or 0))
        faults, seen = "", set()
        for _, r, x in rs:
            shown = re.findall(r"[^\x20\x09-\x0D]", x)
            faults += "b" if not shown else "d" if (r, x) in seen else "t" if shown[-1] not in ".!?" else "-"
            seen.add((r, x))
        turns = [z[0] for z in rs if z[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        queue, done = [(0, "", 0, "", ())], set()
        while True:
            cost, audit, i, state, lines = heapq.heappop(queue)
            if (i, state) in done:
                continue
            done.add((i, state))
            if i == len(rs) and state in ("", "a"):
                break
            free = [x for x in ("user", "assistant") if x[0] in leads[state]]
            for x in free:
                heapq.heappush(queue, (cost + 2, audit + "I", i, x[0], (*lines, x + ":")))
            if i < len(rs):
                _, r, x = rs[i]
                heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state, lines))
                if faults[i] in "-t":
                    more = faults[i] == "t"
                    if r[:1] in leads[state]:
                        heapq.heappush(queue, (cost + more, audit + "K", i + 1, r[0], (*lines, f"{r}:{x}")))
                    for y in free:
                        heapq.heappush(queue, (cost + 2 + more, audit + "R", i + 1, y[0], (*lines, f"{y}:{x}")))
        out.append((c, gaps, *(faults.count(k) for k in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def test_repair_brute(spark):
    rows = pd.read_parquet(f"{SF}/conversations.parquet")[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None)
    assert sorted(map(tuple, conversation_repair.op13_conversation_repair(spark, SF).collect()), key=str) == repaired(rows)


def test_repair_odd_rows(spark):
    rng, rows = random.Random(3), []
    for c in [*range(300), None]:
        turns = [*range(rng.randint(1, 9)), *([None] if rng.random() < 0.3 else [])]
        rng.shuffle(turns)
        rows += [(c, t, rng.choice(["user", "assistant", "system", "tool", "user", None]), rng.choice(["A.", "B!", " x", "", None, "ok?\n", "..", "\x0b", "\xa0"])) for t in turns]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, cost string").repartition(5)
    assert sorted(map(tuple, conversation_repair.repair(conversation_repair.damage(df)).collect()), key=str) == repaired(rows)


def test_repair_edges(spark):
    schema = "conv_id long, turn long, role string, text string, copies int"
    nothing = hashlib.sha256(b"").hexdigest()
    got = conversation_repair.repair(spark.createDataFrame([(1, 5, "user", "Hi.", 0), (2, 0, "", "Hi.", 1), (3, 1, "user", "Hi.", 1), (3, 1, "user", "Hi.", 2)], schema)).collect()
    got = {r["conv_id"]: tuple(r)[1:] for r in got}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", nothing)
    assert got[2] == (0, 0, 0, 0, 0, 3, "D", nothing)
    # one of three equal rows stays (the first: the others are its repeats), and an assistant's turn follows it; a delete is the lesser letter
    assert got[3] == (0, 0, 2, 0, 2, 8, "KDDI", hashlib.sha256(b"user:Hi.\nassistant:").hexdigest())
    assert conversation_repair.repair(spark.createDataFrame([], schema)).count() == 0


def test_repair_long_conversation():
    """Distances and walk are linear in the rows."""
    rng = random.Random(1)
    roles, faults = [rng.choice("sua") for _ in range(50_000)], bytes(rng.choice((0, 0, 0, 1, 3)) for _ in range(50_000))
    cost, audit = conversation_repair.cheapest(roles, faults)
    assert len(audit) - audit.count("I") == 50_000
    paid = 3 * audit.count("D") + 2 * (audit.count("I") + audit.count("R")) + sum(f == 3 and a != "D" for f, a in zip(faults, audit.replace("I", "")))
    assert paid == cost
