"""Byte-wise dedup by merged Burrows-Wheeler transforms against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import suffixmerge


def brute_bytes(rows, n):
    """``(id, n_bytes, n_removed, n_spans, kept)`` of each row; rows that repeat an id and its text are one document."""
    order = {x: k for k, x in enumerate(sorted({(i is not None, i or 0, t or "") for i, t in rows}))}
    seen = {}
    for (_, _, t), k in order.items():
        data = t.encode()
        for p in range(len(data) - n + 1):
            seen.setdefault(data[p : p + n], (k, p))
    out = Counter()
    for i, t in rows:
        k, data = order[i is not None, i or 0, t or ""], (t or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - n + 1):
            if seen[data[p : p + n]] < (k, p):
                gone[p : p + n] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i, len(data), int(gone.sum()), spans, bytes(np.frombuffer(data, np.uint8)[~gone])] += 1
    return out


def collected(df):
    return Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in df.collect())


def texts():
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "ka ni lo été 中文 sup".split() for b in "ran tel mi 😀 ox".split()]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage = [prose(30) for _ in range(4)]
    rows = [(i * 2, prose(rng.randint(0, 40)) + rng.choice(passage) + prose(rng.randint(0, 25)) + (rng.choice(passage) if i % 3 else "")) for i in range(60)]
    rows += [(1000, None), (1001, ""), (1002, "x" * 700), (1003, "ab" * 300 + "x" * 120), (1004, "short"), (1005, "\x00" * 150 + "é" * 100), (1006, "\x00" * 130)]
    rows += [rows[3], rows[3], (1, rows[4][1]), (7, rows[5][1][:150]), (None, rows[6][1]), (3, "one"), (3, rows[7][1])]
    edge = prose(18)  # shorter than a string, so that every other one reaches beyond it
    rows += [(2000 + k, f"{k * 7919 % 1000:04d}" * 9 + edge + f"{k * 104729 % 10000:05d}" * 9) for k in range(30)]
    return rows


@pytest.mark.parametrize("n, most, shard", [(100, 1 << 24, 3 << 19), (100, 500, 2000), (37, 1 << 24, 500), (64, 100, 3 << 19)])
def test_bytes(spark, n, most, shard, monkeypatch):
    monkeypatch.setattr(suffixmerge, "SHARD", shard)
    monkeypatch.setattr(suffixmerge, "CHUNK", shard)
    monkeypatch.setattr(suffixmerge, "POOL", 4 * shard)
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("key", "text_hash", "id", "bucket", "first", "words", "n_bytes")})
    assert collected(suffixmerge.remove_repeats(docs.repartition(5), n, most=most)) == brute_bytes(rows, n)


def test_a_sketch_that_is_too_small_loses_nothing(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert collected(suffixmerge.remove_repeats(docs.repartition(3), 100, max_bits=1 << 16)) == brute_bytes(rows, 100)


def test_nothing_and_ids_that_are_no_integers(spark):
    assert suffixmerge.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError, match="integer"):
        suffixmerge.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_a_very_long_text_of_one_character_and_a_common_passage(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{k} " * 40 + passage) for k in range(300)] + [(1000, "a" * 300_000), (1001, "b" + "a" * 200_000)]
    got = {r.id: r for r in suffixmerge.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got[1000].n_removed == 300_000 - 1 and got[1000].n_spans == 1
    assert got[1001].n_removed == 200_000
    want = brute_bytes(rows[:300], 100)
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for i, r in got.items() if i < 1000) == want


def strings(rng, count, alphabet, low, high):
    length = rng.integers(low, high, count)
    data = rng.integers(97, 97 + alphabet, length.sum()).astype(np.uint8)
    return data, np.cumsum(length) - length, length


@pytest.mark.parametrize("seed", range(20))
def test_suffix_order(seed):
    rng = np.random.default_rng(seed)
    data, begin, length = strings(rng, int(rng.integers(1, 8)), int(rng.integers(1, 4)), 16, 60)
    text, left = [], []
    for b, k in zip(begin, length):
        text += [*(data[b : b + k].astype(int) + 1), 0]
        left += range(k, -1, -1)
    order, _, _ = suffixmerge.sorted_suffixes(np.array(text, np.uint16), np.array(left, np.int32), 16)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: (text[i : i + left[i] + 1], i))


@pytest.mark.parametrize("seed, n", [(s, n) for s in range(6) for n in (16, 21, 40, 100)])
def test_merged_transforms_give_the_repeated_intervals(seed, n):
    """Rows that share n characters with another shard, by comparing all suffixes."""
    rng = np.random.default_rng(seed)
    common = rng.integers(97, 100, 150).astype(np.uint8)
    payloads, suffixes = [], []
    for shard in range(4):
        data, begin, length = strings(rng, 5, 3, n, n + 60)
        data[: min(len(common), len(data))] = common[: len(data)] if shard % 2 else data[: min(len(common), len(data))]
        for batch in suffixmerge.transforms(data, begin, length, np.zeros(5, np.int64), np.arange(5) + 10 * shard, np.zeros(5, np.int64), np.zeros(5, np.int64), n):
            payloads += [x for x in batch.column("payload").to_pylist() if x]
        suffixes += [(shard, bytes(data[b + p : b + p + n])) for b, k in zip(begin, length) for p in range(k - n + 1)]
    symbols, owner, before, key, *_ = suffixmerge.unpacked(payloads)
    assert len(key) == 20
    row, block = suffixmerge.interleaved(symbols, owner, before, n)
    shards = {}
    for s, x in suffixes:
        shards.setdefault(x, set()).add(s)
    shared = Counter(x for s, x in suffixes if len(shards[x]) > 1)
    assert sorted(Counter(block.tolist()).values()) == sorted(shared.values())


def handed_on(texts, n, tasks):
    """Rows that ``tasks`` tasks hand on of texts, all to one bucket, and what they have settled."""
    rows = []
    for task in range(tasks):
        held = suffixmerge.Strings()
        for k in range(task, len(texts), tasks):
            data = np.frombuffer(texts[k], np.uint8)
            h, start, count, anchor = suffixmerge.runs(data, np.array([0, len(data)]), n)
            length = count + n - 1
            same = np.zeros_like(start)
            found = np.stack((start, length, anchor.view(np.int64), same + k, same, start))
            again = held.add(data, suffixmerge.whole_hashes(h, start, length, n).view(np.int64), found)
            rows.append(suffixmerge.found_again(*found[[3, 4, 5, 1]][:, again]))
        rows += held.handed_on(1)
    return [r for b in rows for r in b.to_pylist()]


def places(rows, n):
    return {(r["key"], r["first"] + p) for r in rows if r["bucket"] < 0 for p in range(r["words"] - n + 1)}


def brute_places(texts, n):
    seen, out = set(), set()
    for k, t in enumerate(texts):
        for p in range(len(t) - n + 1):
            if t[p : p + n] in seen:
                out.add((k, p))
            seen.add(t[p : p + n])
    return out


@pytest.mark.parametrize("seed, n, shard", [(s, n, k) for s in range(3) for n, k in ((16, 1 << 18), (40, 300), (100, 1000), (100, 1))])
def test_runs_of_a_bucket(seed, n, shard, monkeypatch):
    """Shards of all sizes: with small ones the runs of an anchor are sorted in several and their transforms merged."""
    rng = np.random.default_rng(seed)
    piece = [rng.integers(97, 123, int(k)).astype(np.uint8).tobytes() for k in rng.integers(n // 4, 3 * n, 12)]
    texts = [b"".join(piece[i] for i in rng.integers(0, 12, 6)) for _ in range(25)] + [b"a" * 3 * n, b"ab" * 2 * n, b"b" + b"a" * 2 * n]
    texts += [bytes([65 + k % 26]) * 7 + piece[0] + b"%d" % k * n for k in range(40)]
    merges = []
    merged = suffixmerge.merged
    monkeypatch.setattr(suffixmerge, "merged", lambda payloads, n: (merges.append(len(payloads)), merged(payloads, n))[1])
    monkeypatch.setattr(suffixmerge, "SHARD", shard)
    rows = handed_on(texts, n, 4)
    for batch in suffixmerge.settled([r["payload"] for r in rows if r["payload"]], n):
        rows += batch.to_pylist()
    assert places(rows, n) == brute_places(texts, n)
    assert (max(merges) > 1) == (shard == 1 or shard == 300) or shard == 1000


def test_of_a_passage_in_several_tasks_only_the_edges_are_sorted(monkeypatch):
    rng = np.random.default_rng(1)
    passage = rng.integers(97, 123, 20_000).astype(np.uint8).tobytes()
    texts = [rng.integers(97, 123, 500).astype(np.uint8).tobytes() + passage for _ in range(8)]
    sizes = []
    sort = suffixmerge.sorted_suffixes
    monkeypatch.setattr(suffixmerge, "sorted_suffixes", lambda text, left, n: (sizes.append(len(text)), sort(text, left, n))[1])
    rows = handed_on(texts, 100, 8)
    for batch in suffixmerge.settled([r["payload"] for r in rows if r["payload"]], 100):
        rows += batch.to_pylist()
    assert places(rows, 100) == brute_places(texts, 100)
    # All eight tasks sorted the passage before, nearly four bytes of strings for each of its bytes.
    assert 0 < sum(sizes) < len(passage)


def test_strings_of_a_common_anchor_one_by_one():
    rng = np.random.default_rng(2)
    line = rng.integers(97, 123, 60).astype(np.uint8).tobytes()
    texts = [rng.integers(97, 123, 90).astype(np.uint8).tobytes() + line + rng.integers(97, 123, 90).astype(np.uint8).tobytes() for _ in range(30)]
    texts += [texts[3][20:], texts[5][:170], texts[5][10:]]
    rows = handed_on(texts, 100, 3)
    dealt = [r for x in rows if x["payload"] for b in suffixmerge.single(x["payload"], 5, 1 << 31, 100) for r in b.to_pylist()]
    assert {r["bucket"] for r in dealt if r["payload"]} == set(range(1 << 31, (1 << 31) + 5))
    found = [r for r in (*rows, *dealt) if r["bucket"] < 0]
    for bucket in range(1 << 31, (1 << 31) + 5):
        for batch in suffixmerge.settled([r["payload"] for r in dealt if r["bucket"] == bucket], 100):
            found += batch.to_pylist()
    assert places(found, 100) == brute_places(texts, 100)
